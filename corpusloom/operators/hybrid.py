"""Hybrid search of a table of queries: terms and vectors, each within scopes and filters, MMR, fusion, parents, rerank."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import dense, ranking, selection, sparse
from corpusloom.session import durable

KEYS = ["query_id", "scope_id"]
#: Most numbers that the similarities of a group of queries take while MMR reselects.
MMR_CELLS = 1 << 22


@dataclass(frozen=True)
class Corpus:
    """Children written once with file number, filter bits and vector; their term index; scopes and their depths."""

    children: DataFrame
    index: sparse.SparseIndex
    scopes: selection.Scopes
    depths: DataFrame
    filters: Mapping[str, Mapping[str, Any]]
    variant: str


def corpus(
    children: DataFrame, scopes: DataFrame, *, filters: Mapping[str, Mapping[str, Any]] | None = None,
    embedder=dense.letter_embedding, variant: str = "lucene",
) -> Corpus:
    """Prepare ``children`` (child_id, parent_id, file_id, text, metadata…) for ``search``.

    ``scopes`` has (scope_id, file_id) rows; a file may be in many scopes. ``filters`` are named conditions on the
    children's columns. Statistics of terms cover all children, whatever a query's scope or filter.
    """
    filters = dict(filters or {})
    bits = selection.scope_bits(scopes)
    rows = children.withColumn("seen", selection.filter_bits(filters)).join(bits.files(), "file_id", "left")
    written = durable(dense.embed(rows.select("child_id", "parent_id", "file_id", "file_no", "seen", "text"), "text", embedder))
    counts = written.groupBy("file_id").agg(F.count("*").alias("n"))
    depths = ranking.adaptive_k(bits.members.join(counts, "file_id"), ["scope_id"], count=F.sum("n"))
    index = sparse.build_index(written.select("child_id", "file_no", "seen", "text"), keep=("file_no", "seen"), variant=variant)
    return Corpus(written, index, bits, durable(depths), filters, variant)


def ask(queries: DataFrame, within: Corpus) -> DataFrame:
    """Queries (query_id, scope_id, text, and if they like filter_id and k_override) with their depths.

    A query's own ``k_override`` replaces ``k`` for both lists and nothing else. Queries in a scope without children have
    nothing to find and drop out; ``filters.check_queries`` names them.
    """
    extra = {"filter_id": "string", "k_override": "int"}
    rows = queries.select(*KEYS, "text", *[F.col(c) if c in queries.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    rows = rows.join(within.depths, "scope_id").withColumn("filter_no", selection.filter_number(within.filters, F.col("filter_id")))
    return durable(rows.withColumn("k", F.coalesce("k_override", "k")).drop("filter_id", "k_override"))


def _most(asked: DataFrame, column: str) -> int:
    return asked.agg(F.max(column)).first()[0] or 0


def _depth(ranked: DataFrame, asked: DataFrame, depth: str) -> DataFrame:
    return ranking.cut(ranked, asked.select(*KEYS, depth), KEYS, depth)


def term_list(asked: DataFrame, within: Corpus, *, prune: bool = False) -> DataFrame:
    """Best ``k`` children by BM25 among those a query may see: (query_id, scope_id, child_id, score, rank)."""

    def test(hits: DataFrame) -> DataFrame:
        return selection.in_scopes(hits.where(selection.passes(F.col("seen"), F.col("filter_no"))), within.scopes)

    visible = sparse.Visible(["scope_id", "filter_no"], ["file_no", "seen"], test)
    found = sparse.bm25(asked, within.index, _most(asked, "k"), variant=within.variant, prune=prune, visible=visible)
    return _depth(found.drop("filter_no"), asked, "k")


def vector_list(asked: DataFrame, within: Corpus, *, embedder=dense.letter_embedding, metric: str = "dot", semantic: str = "mmr", weight: float = 0.5) -> DataFrame:
    """Best ``k`` children by vector among those a query may see; by ``mmr`` chosen out of the nearest ``fetch_k``.

    Vectors are dealt to the pairs of scope and filter that queries use, so that each query meets only what it may see.
    """
    if semantic not in ("mmr", "similarity"):
        raise ValueError(f"unknown kind of search: {semantic}")
    seen = ["scope_id", "filter_no"]
    used = durable(asked.select(*seen).distinct())
    where = within.scopes.members.join(used, "scope_id").select(*seen, "file_id")
    rows = within.children.select("child_id", "file_id", "seen", "embedding").where(F.col("embedding").isNotNull())
    vectors = rows.join(where, "file_id").where(selection.passes(F.col("seen"), F.col("filter_no"))).select("child_id", "embedding", *seen)
    q = durable(dense.embed(asked.select(*KEYS, "filter_no", "text", "k"), "text", embedder).drop("text"))
    deep = _most(asked, "fetch_k" if semantic == "mmr" else "k")
    found = dense.nearest(q.select(*KEYS, "filter_no", "embedding"), vectors, deep, metric=metric, part=seen).drop("filter_no")
    if semantic == "similarity":
        return _depth(found, asked, "k")
    fetched = durable(_depth(found, asked, "fetch_k").select(*KEYS, "child_id", "rank"))
    return reselected(fetched, within.children.select("child_id", "embedding"), q.select(*KEYS, "embedding", "k"), KEYS, weight=weight)


def reselected(fetched: DataFrame, vectors: DataFrame, queries: DataFrame, keys: Sequence[str], *, id_col: str = "child_id", weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: of each query's ``fetched`` (keys, id, rank) the best ``k``: (keys, id, rank).

    ``queries`` has (keys, embedding, k). Each step takes the candidate with the largest weight * similarity to the query -
    (1 - weight) * largest similarity to those taken, by cosine rounded to nine places; ties go to the better rank. A
    query's candidates, as many as were fetched, become one row; batches of queries with equally many candidates are
    reselected at once by matrix products.
    """
    keys = list(keys)
    rows = fetched.join(vectors.select(id_col, "embedding"), id_col)
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "embedding")))
    groups = rows.groupBy(*keys).agg(listed.alias("found"))
    asked = queries.select(*keys, F.col("embedding").alias("query"), F.least("k", F.lit(1 << 30)).alias("k"))
    packed = groups.join(asked, keys).select(
        *keys, F.col("k").cast("int"), F.transform("query", lambda x: x.cast("double")).alias("query"),
        F.transform("found", lambda s: s["id"]).alias("ids"),
        F.flatten(F.transform("found", lambda s: F.transform(s["embedding"], lambda x: x.cast("double")))).alias("vectors"),
    )
    out = T.StructType([packed.schema[c] for c in keys]).add("ids", packed.schema["ids"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column("ids").offsets.to_numpy())
            flat, ask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("vectors", "query"))
            width = len(ask) // max(batch.num_rows, 1)
            starts, k = np.cumsum(counts) - counts, batch.column("k").to_numpy()
            flat, ask = flat.reshape(-1, width), ask.reshape(-1, width)
            picks: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for n in np.unique(counts):
                same = np.flatnonzero(counts == n)
                step = max(1, MMR_CELLS // max(n * n, n * width))
                for some in np.split(same, range(step, len(same), step)):
                    order = spread(flat[starts[some][:, None] + np.arange(n)], ask[some], int(k[some].max()), weight)
                    for row, chosen in zip(some, order):
                        picks[row] = starts[row] + chosen[: k[row]]
            ids = batch.column("ids").flatten().take(pa.array(np.concatenate(picks) if picks else [], pa.int64()))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in picks])]), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.ListArray.from_arrays(ends, ids)], [*keys, "ids"])

    chosen = packed.mapInArrow(run, out).select(*keys, F.posexplode("ids").alias("place", id_col))
    return chosen.select(*keys, id_col, (F.col("place") + 1).alias("rank"))


def spread(vectors: np.ndarray, queries: np.ndarray, k: int, weight: float) -> np.ndarray:
    """(group, step) the candidates taken, for (group, candidate, width) vectors in rank order."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    vectors, queries = unit(vectors), unit(queries)
    groups, n, _ = vectors.shape
    relevance = np.round(np.einsum("gnd,gd->gn", vectors, queries), 9)
    alike = np.round(vectors @ vectors.transpose(0, 2, 1), 9)
    closest, gain = np.full((groups, n), -np.inf), relevance.copy()
    each, order = np.arange(groups), []
    for _ in range(min(k, n)):
        best = gain.argmax(axis=1)
        order.append(best)
        closest = np.maximum(closest, alike[each, best])
        taken = np.isneginf(gain)
        taken[each, best] = True
        gain = np.where(taken, -np.inf, np.round(weight * relevance - (1 - weight) * closest, 9))
    return np.array(order).reshape(len(order), groups).T


def fused(asked: DataFrame, within: Corpus, *, weights: tuple[float, float] = (0.5, 0.5), **options) -> DataFrame:
    """Both lists fused by reciprocal rank: (query_id, scope_id, child_id, score, rank)."""
    lists = [(term_list(asked, within), weights[0]), (vector_list(asked, within, **options), weights[1])]
    return ranking.fuse(lists, KEYS, upper=2 * _most(asked, "k"))


def search(queries: DataFrame, within: Corpus, parents: DataFrame, *, rerank: bool = True, **options) -> DataFrame:
    """Parents for each query: (query_id, scope_id, parent_id, rank, score, reranked)."""
    asked = ask(queries, within)
    kept = _depth(fused(asked, within, **options), asked, "rrf_k")
    found = ranking.backtrack(kept, within.children.select("child_id", "parent_id"), KEYS)
    return ranking.rerank(durable(found), asked.select(*KEYS, "text"), parents, KEYS, enabled=rerank)
