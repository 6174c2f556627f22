"""Exact and approximate nearest neighbours of a whole table of query vectors, and MMR.

Vectors are dealt into blocks of bounded size. A grid cell holds one block of queries and one block of vectors of
the same scope; it multiplies two small matrices and sends on only the best ``k`` per query. A scope that holds a
third of all vectors is many cells, never one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.text import let, record
from corpusloom.operators.running import top_rows
from corpusloom.session import durable

VECTOR_BLOCK = 8192
QUERY_BLOCK = 4096
#: Approximate search: rows per bucket, most hash bits, recall on the sampled queries, and their number.
BUCKET, MOST_BITS, RECALL, SAMPLE = 4096, 12, 0.95, 200
# Fixed value: letters counted by the built-in stand-in embedder.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedding(text: Column) -> Column:
    """Deterministic stand-in for an embedding model: unit vector of letter counts, counted by Arrow batches; null for a
    text without such letters. Not a model's output."""
    @F.arrow_udf("array<double>")
    def vectors(low: pa.Array) -> pa.Array:
        low = pc.fill_null(low.cast(pa.large_binary()), b"")
        at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
        letter = np.frombuffer(low.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] - np.uint8(ord(LETTERS[0]))
        row = np.repeat(np.arange(len(low)), np.diff(at))
        places = (row * len(LETTERS) + letter)[letter < len(LETTERS)]
        counts = np.bincount(places, minlength=len(low) * len(LETTERS)).reshape(len(low), len(LETTERS)).astype(float)
        length = np.sqrt(np.square(counts).sum(axis=1))
        some = length > 0
        flat = (counts[some] / length[some, None]).ravel()
        ends = np.concatenate([[0], np.cumsum(some)]) * len(LETTERS)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(~some))

    return vectors(F.lower(text))


def unit(vector: Column) -> Column:
    """Vector scaled to length one; null for the zero vector."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    with_length = let(vector, lambda v: record(v=v, n=length(v)))
    return let(with_length, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])))


def embed(df: DataFrame, text: str, embedder, out: str = "embedding") -> DataFrame:
    """Slot for a model: any column function (native or pandas UDF) text -> array of numbers."""
    return df.withColumn(out, embedder(F.col(text)))


def mixed_models(vectors: DataFrame, model: str = "model", vector: str = "embedding") -> DataFrame:
    """Rows whose vector length differs from the most frequent one of their model."""
    sizes = vectors.groupBy(model, F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    main = sizes.groupBy(model).agg(F.max_by("dim", F.struct("n", "dim")).alias("main_dim"))
    return vectors.join(main, model).where(F.size(vector) != F.col("main_dim"))


def _similarity(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer."""
    if metric == "l2":
        return 2.0 * queries @ vectors.T - np.square(queries).sum(axis=1)[:, None] - np.square(vectors).sum(axis=1)[None, :]
    if metric == "cosine":
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    return queries @ vectors.T


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).unique()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist())}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _deal(df: DataFrame, key: str, sizes: DataFrame, part: Sequence[str], mine: tuple, theirs: tuple) -> DataFrame:
    """Give each row its own block number and copy it to every block of the other side of its part.

    ``mine`` and ``theirs`` are (block column, rows-per-part column, rows per block).
    """
    blocks = lambda side: F.ceil(F.col(side[1]) / side[2]).cast("int")
    return (
        df.join(sizes, list(part))
        .withColumn(mine[0], F.pmod(F.xxhash64(key), blocks(mine)).cast("int"))
        .withColumn(theirs[0], F.explode(F.sequence(F.lit(0), blocks(theirs) - 1)))
        .drop(mine[1], theirs[1])
    )


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    metric: str = "l2",
    part: Sequence[str] = (),
    query_id: str = "query_id",
    vector_id: str = "child_id",
    min_score: float | None = None,
    skip_self: bool = False,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact best ``k`` per query: (query_id, part…, vector_id, score, rank), ties to the smaller id.

    ``part`` names columns on both sides that must be equal: a scope, a language, an LSH bucket. ``score`` is the inner
    product, the cosine, or minus the squared distance. ``min_score`` is applied before ranking.
    """
    part = list(part) or ["_all"]
    if part == ["_all"]:
        queries = queries.withColumn("_all", F.lit(0))
        vectors = vectors.withColumn("_all", F.lit(0))
    # Aliases give both sides columns of their own, also where queries and vectors are one table.
    own = lambda names: [F.col(n).alias(n) for n in names]
    q = queries.select(*own([query_id, *part]), F.col("embedding").alias("q_vec")).where(F.col("q_vec").isNotNull())
    v = vectors.select(*own([vector_id, *part]), F.col("embedding").alias("v_vec")).where(F.col("v_vec").isNotNull())
    # One row per part, written so that Spark knows its size: where it is small, no vector moves before the cells.
    sizes = durable(
        q.groupBy(*part).agg(F.count("*").alias("_qn")).join(v.groupBy(*part).agg(F.count("*").alias("_vn")), part)
    )
    q_side, v_side = ("_qb", "_qn", query_block), ("_vb", "_vn", vector_block)
    q_cells = _deal(q, query_id, sizes, part, q_side, v_side)
    v_cells = _deal(v, vector_id, sizes, part, v_side, q_side)
    cell = [*part, "_vb", "_qb"]

    fields = [q.schema[query_id], *[q.schema[p] for p in part], v.schema[vector_id], T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        left, right = left.combine_chunks(), right.combine_chunks()
        right = right.take(pc.sort_indices(right, sort_keys=[(vector_id, "ascending")], null_placement="at_start"))
        ids, query_ids = (t.column(c).combine_chunks() for t, c in ((right, vector_id), (left, query_id)))
        matrix, asked = _matrix(right.column("v_vec")), _matrix(left.column("q_vec"))
        own = None
        if skip_self:
            own = pc.index_in(query_ids, value_set=ids.cast(query_ids.type)).to_numpy(zero_copy_only=False)
            same = pc.run_end_encode(ids)  # a repeated id is left out as often as it occurs
            ends = same.run_ends.to_numpy()
        of, places, values = [], [], []
        for at in range(0, len(asked), 256):
            scores = np.round(_similarity(asked[at : at + 256], matrix, metric), 9)
            for no, row in enumerate(scores, at):
                usable = np.ones(len(row), dtype=bool)
                if own is not None and not np.isnan(own[no]):
                    usable[int(own[no]) : ends[np.searchsorted(ends, int(own[no]), "right")]] = False
                if min_score is not None:
                    usable &= row >= min_score
                pool = np.flatnonzero(usable)
                if len(pool) > k:
                    cut = np.partition(row[pool], len(pool) - k)[len(pool) - k]
                    pool = pool[row[pool] >= cut]
                best = pool[np.argsort(-row[pool], kind="stable")][:k]
                of.append(np.full(len(best), no))
                places.append(best)
                values.append(row[best])
        of, places, values = (np.concatenate(x) for x in (of, places, values))
        first = {p: left.column(p).take(pa.array(of)) for p in part}
        return pa.table({query_id: query_ids.take(pa.array(of)), **first, vector_id: ids.take(pa.array(places)), "score": pa.array(values, pa.float64())})

    nothing = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema.fields})
    found = q_cells.groupBy(*cell).cogroup(v_cells.groupBy(*cell)).applyInArrow(run, schema)
    keys = [query_id, *[p for p in part if p != "_all"]]
    ranked = top_rows(found, keys, [F.desc("score"), F.asc(vector_id)], k)
    return ranked.select(*keys, vector_id, "score", "rank")


def planes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def with_buckets(df: DataFrame, dim: int, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """Random-hyperplane signatures: one row per hash table with the bucket of the vector."""
    normals = planes(dim, bits, tables, seed)
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def buckets(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        signs = np.einsum("tbd,nd->ntb", normals, matrix) > 0
        return pd.Series(list(signs.astype(np.int64) @ weights))

    return df.select(*df.columns, F.posexplode(buckets("embedding")).alias("_table", "_bucket"))


def with_probes(df: DataFrame, dim: int, bits: int, tables: int, reach: float, seed: int = 7) -> DataFrame:
    """One row per bucket that a query looks into: its own, and those beyond hyperplanes that pass near it.

    A bucket's distance is the sum of the squared distances to the hyperplanes between it and the query, in units of the
    query's length; buckets up to ``reach`` away are probed.
    """
    normals = planes(dim, bits, tables, seed)

    @F.pandas_udf("array<bigint>")
    def buckets(vectors: pd.Series) -> pd.Series:
        out = []
        step = max(1, (1 << 22) // (tables << bits))
        for at in range(0, len(vectors), step):
            own, away = _flips(np.stack(vectors.iloc[at : at + step].to_numpy()).astype(np.float64), normals)
            for mine, far in zip(own, away):
                table, flip = np.nonzero(far <= reach)
                out.append((table << bits) | (mine[table] ^ flip))
        return pd.Series(out)

    code = F.col("_code")
    rows = df.select(*df.columns, F.explode(buckets("embedding")).alias("_code"))
    return rows.select(*df.columns, F.shiftright(code, bits).cast("int").alias("_table"), code.bitwiseAND(F.lit((1 << bits) - 1)).alias("_bucket"))


def _flips(queries: np.ndarray, normals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's bucket per table, and how far away the bucket is that differs in the bits of a mask, for every mask."""
    bits = normals.shape[1]
    sides = np.einsum("tbd,nd->ntb", normals, queries)
    masks = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    length = np.maximum(np.square(queries).sum(axis=1), 1e-300)[:, None, None]
    return (sides > 0).astype(np.int64) @ (1 << np.arange(bits)), (np.square(sides) / length) @ masks.T


def needed_reach(
    queries: DataFrame, vectors: DataFrame, k: int, dim: int, bits: int, tables: int, recall: float, *, metric: str = "cosine",
    query_id: str = "query_id", vector_id: str = "child_id", skip_self: bool = False, seed: int = 7,
) -> float:
    """The reach at which ``SAMPLE`` queries, drawn by hash, find ``recall`` of their exact neighbours.

    The exact search compares the sample with every vector; its SAMPLE * k pairs come to the driver.
    """
    some = durable(queries.select(query_id, "embedding").orderBy(F.xxhash64(query_id), query_id).limit(SAMPLE))
    best = nearest(some, vectors, k, metric=metric, query_id=query_id, vector_id=vector_id, skip_self=skip_self).select(query_id, vector_id)
    asked = some.select(query_id, F.col("embedding").alias("q_vec"))
    pairs = best.join(F.broadcast(asked), query_id).join(vectors.select(vector_id, "embedding"), vector_id).select("q_vec", "embedding").collect()
    if not pairs:
        return 0.0
    normals = planes(dim, bits, tables, seed)
    own, away = _flips(np.array([r[0] for r in pairs], dtype=np.float64), normals)
    theirs, _ = _flips(np.array([r[1] for r in pairs], dtype=np.float64), normals)
    needed = np.take_along_axis(away, (own ^ theirs)[:, :, None], axis=2)[:, :, 0].min(axis=1)
    return float(np.sort(needed)[math.ceil(recall * len(needed)) - 1]) * (1 + 1e-9)


def approximate(
    queries: DataFrame, vectors: DataFrame, k: int, dim: int, *, metric: str = "cosine", bits: int | None = None, tables: int = 1,
    recall: float = RECALL, query_id: str = "query_id", vector_id: str = "child_id", skip_self: bool = False, seed: int = 7,
) -> DataFrame:
    """Nearest neighbours inside LSH buckets. Buckets go through the same bounded cells as scopes do.

    Without ``bits`` a bucket holds about ``BUCKET`` rows. Each query probes as many near buckets as a sample of queries
    needs to find ``recall`` of its exact neighbours, so the result keeps that recall on any data, up to sampling error.
    """
    queries, vectors = (df.where(F.col("embedding").isNotNull()) for df in (queries, vectors))
    if bits is None:
        bits = min(max(1, math.ceil(math.log2(max(vectors.count(), 1) / BUCKET))), MOST_BITS)
    names = {"metric": metric, "query_id": query_id, "vector_id": vector_id, "skip_self": skip_self}
    reach = needed_reach(queries, vectors, k, dim, bits, tables, recall, seed=seed, **names)
    found = nearest(
        with_probes(queries, dim, bits, tables, reach, seed), with_buckets(vectors, dim, bits, tables, seed), k, part=["_table", "_bucket"], **names
    )
    once = found.groupBy(query_id, vector_id).agg(F.max("score").alias("score"))
    return top_rows(once, [query_id], [F.desc("score"), F.asc(vector_id)], k)


def mmr(
    candidates: DataFrame, k: int, *, weight: float = 0.5, query_id: str = "query_id", vector_id: str = "child_id", part: Sequence[str] = (),
) -> DataFrame:
    """Maximal marginal relevance over each query's fetched candidates, in each scope (``part``) by itself.

    ``candidates`` has (query_id, *part, vector_id, rank, query_vec, embedding); a group is at most ``fetch_k`` rows.
    """
    keys = [query_id, *part]
    schema = T.StructType(
        [*[T.StructField(c, candidates.schema[c].dataType) for c in keys], T.StructField(vector_id, candidates.schema[vector_id].dataType),
         T.StructField("rank", T.IntegerType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        matrix = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        query = np.asarray(pdf["query_vec"].iloc[0], dtype=np.float64)
        query = query / max(np.linalg.norm(query), 1e-300)
        relevance = np.round(matrix @ query, 9)
        closest = np.full(len(pdf), -np.inf)
        open_ = np.ones(len(pdf), dtype=bool)
        chosen: list[int] = []
        while open_.any() and len(chosen) < k:
            gain = relevance if not chosen else weight * relevance - (1 - weight) * closest
            gain = np.where(open_, np.round(gain, 9), -np.inf)
            pick = int(np.argmax(gain))
            chosen.append(pick)
            open_[pick] = False
            closest = np.maximum(closest, np.round(matrix @ matrix[pick], 9))
        ids = pdf[vector_id].to_numpy()
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, vector_id: ids[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return candidates.groupBy(*keys).applyInPandas(run, schema)


def mmr_search(queries: DataFrame, vectors: DataFrame, k: int, fetch_k: int, *, metric: str = "l2", part: Sequence[str] = (), weight: float = 0.5, query_id: str = "query_id", vector_id: str = "child_id", skip_self: bool = False) -> DataFrame:
    """Fetch the nearest ``fetch_k``, then reselect ``k`` of them by MMR."""
    fetched = nearest(queries, vectors, fetch_k, metric=metric, part=part, query_id=query_id, vector_id=vector_id, skip_self=skip_self)
    with_vectors = fetched.join(vectors.select(*part, vector_id, "embedding"), [*part, vector_id])
    with_query = with_vectors.join(queries.select(*part, query_id, F.col("embedding").alias("query_vec")), [*part, query_id])
    return mmr(with_query.select(query_id, *part, vector_id, "rank", "query_vec", "embedding"), k, weight=weight, query_id=query_id, vector_id=vector_id, part=part)
