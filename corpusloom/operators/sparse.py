"""Term postings and BM25 search of a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import STOP_WORDS, let, record, terms
from corpusloom.operators.running import top_rows
from corpusloom.session import durable

# k1, b and delta of each formula.
VARIANTS = {"lucene": (1.2, 0.75, 0.0), "okapi": (1.5, 0.75, 0.0), "plus": (1.5, 0.75, 1.0)}
SEED_POSTINGS = 20000
#: Chunks and queries of a cell, and about how many sums it holds at a time.
CHUNK_BLOCK, QUERY_BLOCK, CELL = 32768, 4096, 1 << 22
#: Up to so many terms of queries, in rows and bytes, go to the postings by a broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 17, 1 << 22


@dataclass(frozen=True)
class SparseIndex:
    """``forward``: one row per chunk with its term counts; ``postings``: one row per (term, chunk); ``term_stats``:
    document frequency and largest term weight; ``corpus``: one row (n, avgdl).

    A search deals the index by chunk, not by term: of the postings only those of the queries' terms move, a frequent term
    is spread over all tasks, all hits of a chunk meet in one task, and scores are summed and cut to the best ``k`` there.
    """

    forward: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    id_col: str


def counted(tokens: Column) -> Column:
    """Array of (term, tf) of one text, by runs of its sorted tokens. Counting in the row saves a shuffle."""
    none = F.array().cast("array<struct<term:string,tf:int>>")

    def runs(found: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), first)

        def counts(at: Column) -> Column:
            return F.transform(at, lambda i, j: record(term=F.get(found, i), tf=F.coalesce(F.get(at, j + 1), F.size(found)) - i))

        return let(starts, counts)

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(none)


def saturation(tf: Column, dl: Column, avgdl: Column, variant: str = "lucene") -> Column:
    """The query-independent part of a term's score."""
    k1, b, delta = VARIANTS[variant]
    norm = tf + k1 * (1 - b + b * dl / avgdl)
    return tf / norm if variant == "lucene" else delta + tf * (k1 + 1) / norm


def inverse_frequency(n: Column, df: Column, variant: str = "lucene") -> Column:
    if variant == "plus":
        return F.log((n + 1) / df)
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log(odds) if variant == "okapi" else F.log(1 + odds)


def build_index(
    chunks: DataFrame,
    id_col: str = "child_id",
    text: str = "text",
    keep: Sequence[str] = (),
    stop_words: Sequence[str] = STOP_WORDS,
    variant: str = "lucene",
) -> SparseIndex:
    """Statistics cover the whole corpus, whatever a later search filters.

    Chunks are tokenised once; the forward table is written to the shared folder and everything else reads it.
    """
    tokens = chunks.select(id_col, *keep, terms(F.col(text), stop_words).alias("tokens"))
    written = durable(tokens.select(id_col, *keep, F.size("tokens").alias("dl"), counted(F.col("tokens")).alias("counts")))
    forward = written.where(F.col("dl") > 0)  # after it was written: a filter on the tokens would make them twice
    corpus = forward.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def entries(rows: DataFrame) -> DataFrame:
        hits = rows.select(id_col, *keep, "dl", F.explode("counts").alias("c"))
        return hits.select(F.col("c.term").alias("term"), id_col, *keep, F.col("c.tf").alias("tf"), "dl")

    avgdl = corpus.select("avgdl").scalar()
    term_stats = entries(forward).groupBy("term").agg(
        F.count("*").alias("df"), F.max(saturation(F.col("tf"), F.col("dl"), avgdl, variant)).alias("top_weight")
    )
    return SparseIndex(forward, entries(forward), term_stats, corpus, id_col)


def query_terms(queries: DataFrame, index: SparseIndex, keep: Sequence[str] = (), stop_words=STOP_WORDS, variant="lucene") -> DataFrame:
    """(query_id, keep…, term, weight, df, top_score): a query's terms with everything that depends on the term only."""
    n = index.corpus.select("n").scalar()
    found = counted(terms(F.col("text"), stop_words))
    exploded = queries.select("query_id", *keep, F.explode(found).alias("q")).select(
        "query_id", *keep, F.col("q.term").alias("term"), F.col("q.tf").alias("qtf")
    )
    idf = inverse_frequency(n, F.col("df"), variant)
    if variant == "okapi":
        # Terms in more than half of all chunks would score below zero: they get a quarter of the mean instead.
        mean = index.term_stats.agg(F.avg(inverse_frequency(n, F.col("df"), variant)).alias("m")).scalar()
        idf = F.when(idf < 0, 0.25 * mean).otherwise(idf)
    joined = exploded.join(index.term_stats, "term").withColumn("weight", F.col("qtf") * idf)
    return joined.select("query_id", *keep, "term", "weight", "df", (F.col("weight") * F.col("top_weight")).alias("top_score"))


@dataclass(frozen=True)
class Visible:
    """Which chunks a query may see, beyond equal columns: ``carry`` names query columns, ``columns`` chunk columns that
    ``test`` needs; ``test`` takes the hits with both and returns those that count."""

    carry: Sequence[str] = ()
    columns: Sequence[str] = ()
    test: Callable[[DataFrame], DataFrame] = lambda hits: hits


def _numbered(rows: DataFrame, columns: Sequence[str], number: str) -> tuple[DataFrame, DataFrame]:
    """Each distinct value of ``columns`` with a number, as a written table, and ``rows`` with that number."""
    table = durable(rows.select(*columns).distinct().withColumn(number, F.monotonically_increasing_id()))
    right = table.select(*[F.col(c).alias(f"_of_{c}") for c in columns], number)
    same = reduce(Column.__and__, [rows[c].eqNullSafe(F.col(f"_of_{c}")) for c in columns])
    return table, rows.join(right, same).select(*rows.columns, number)


def _bounded(need: DataFrame) -> DataFrame:
    """Marked for a broadcast while it is small by its own count, whatever Spark's threshold."""
    size = need.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(need) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else need


def _hits(wanted: DataFrame, need: DataFrame, index: SparseIndex, match: Mapping[str, str], variant: str, visible: Visible) -> DataFrame:
    """(_no, id, w): the postings of the terms wanted, once for each kind of query that may see them, whatever the number of queries."""
    avgdl = index.corpus.select("avgdl").scalar()
    used = _bounded(durable(need.join(wanted.select("_no").distinct(), "_no", "left_semi")))
    rows = index.postings.select(
        "term", index.id_col, *[F.col(c).alias(q) for q, c in match.items()], *visible.columns, saturation(F.col("tf"), F.col("dl"), avgdl, variant).alias("w")
    )
    return visible.test(rows.join(used, ["term", *match])).select("_no", index.id_col, "w")


def _sums(left: pa.Table, right: pa.Table, id_col: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For batches of queries: (query, its terms' first row, chunk, score) of all hits, by query and chunk; chunks are numbered in order of ids."""
    column = lambda table, name: table.column(name).to_numpy()
    asked = np.lexsort((column(left, "_no"), column(left, "_q")))
    query, term, weight = (column(left, c)[asked] for c in ("_q", "_no", "weight"))
    found = np.argsort(column(right, "_no"), kind="stable")
    chunks = right.column(id_col).to_numpy()[found]
    term_of, value = column(right, "_no")[found], column(right, "w")[found]
    low, high = np.searchsorted(term_of, term, "left"), np.searchsorted(term_of, term, "right")
    firsts = np.flatnonzero(np.diff(query, prepend=query[0] - 1))  # each query's first term
    ends = np.append(firsts[1:], len(query))
    width, load = int(chunks.max()) + 1, np.concatenate([[0], np.cumsum(high - low)])
    at = 0
    while at < len(firsts):
        most = np.searchsorted(load[ends], load[firsts[at]] + CELL, "right")
        to = int(max(at + 1, min(most, at + max(1, CELL // width))))
        a, b = firsts[at], ends[to - 1]
        n = (high - low)[a:b]
        places = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        no = np.repeat(np.arange(to - at), ends[at:to] - firsts[at:to])  # of each term's query in the batch
        cell = np.repeat(no * width, n) + chunks[places]
        part = np.repeat(weight[a:b], n) * value[places]
        if (to - at) * width <= 8 * len(cell):
            some = np.zeros((to - at) * width, bool)
            some[cell] = True
            which, sums = np.flatnonzero(some), np.bincount(cell, part)
            sums = sums[which]
        else:
            which, inverse = np.unique(cell, return_inverse=True)
            sums = np.bincount(inverse, part, minlength=len(which))
        no, chunk = np.divmod(which, width)
        yield query[firsts[at:to]][no], firsts[at:to][no], chunk, sums.astype(np.float64)
        at = to


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6


def _best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each query, ties to the smaller chunk; rows come by query and chunk."""
    starts = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else []
    kept = []
    for a, b in zip(starts, [*starts[1:], len(query)]):
        pool = np.arange(a, b)
        if b - a > k:
            pool = pool[score[a:b] >= np.partition(score[a:b], b - a - k)[b - a - k]]
        kept.append(pool[np.argsort(-score[pool], kind="stable")][:k])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _cells(wanted: DataFrame, hits: DataFrame, index: SparseIndex, k: int | None) -> DataFrame:
    """(_q, id, score): sums of weight * w by query and chunk, of them each cell's best ``k`` by score rounded to six places.

    ``wanted`` has (_q, _no, weight). Queries and chunks are dealt into blocks of bounded size; a cell holds one of each and
    adds up in arrays, so no hit of a single query is a row of its own. Without ``k`` sums come out that reach the
    query's column ``least``.
    """
    id_col = index.id_col
    blocks = max(1, -(-int(index.corpus.first()["n"] or 0) // CHUNK_BLOCK))
    query_blocks = max(1, -(-wanted.select("_q").distinct().count() // QUERY_BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    block = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    asked = ["_q", "_no", "weight", *(["least"] if k is None else [])]
    left = wanted.select(*asked, block("_q", query_blocks, "_qb"), every(blocks, "_cb")).groupBy("_cb", "_qb")
    right = hits.select("_no", id_col, "w", block(id_col, blocks, "_cb"), every(query_blocks, "_qb")).groupBy("_cb", "_qb")
    kind = hits.schema[id_col].dataType
    out = T.StructType([T.StructField("_q", T.LongType()), T.StructField(id_col, kind), T.StructField("score", T.DoubleType())])

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column(id_col).combine_chunks()
        if not len(ids) or not left.num_rows:
            return pa.table({"_q": pa.array([], pa.int64()), id_col: ids[:0], "score": pa.array([], pa.float64())})
        codes = ids.dictionary_encode("encode")
        order = pc.array_sort_indices(codes.dictionary, null_placement="at_start")
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        right = right.set_column(right.column_names.index(id_col), id_col, pa.array(rank[codes.indices.to_numpy()]))
        least = None if k is not None else left.column("least").to_numpy()[np.lexsort((left.column("_no").to_numpy(), left.column("_q").to_numpy()))]
        found = []
        for query, first, chunk, score in _sums(left, right, id_col):
            if least is None:
                score = _rounded(score)
                some = _best(query, chunk, score, k)
            else:
                some = np.flatnonzero(score >= least[first])
            found.append((query[some], chunk[some], score[some]))
        query, chunk, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"_q": pa.array(query), id_col: codes.dictionary.take(order.take(pa.array(chunk))), "score": pa.array(score)})

    return left.cogroup(right).applyInArrow(run, out)


def bm25(
    queries: DataFrame,
    index: SparseIndex,
    k: int,
    *,
    match: Mapping[str, str] | None = None,
    variant: str = "lucene",
    prune: bool = False,
    stop_words: Sequence[str] = STOP_WORDS,
    seed_postings: int = SEED_POSTINGS,
    visible: Visible = Visible(),
) -> DataFrame:
    """Best ``k`` chunks per query: (query_id, match…, id, score, rank); any matching term counts.

    ``match`` maps query columns to chunk columns that must be equal (a scope). ``prune`` keeps the same result but
    never reads the postings of common terms for chunks that cannot reach the top ``k``. ``visible`` restricts each
    query's hits in any other way; term statistics stay those of the whole corpus.
    """
    match = dict(match or {})
    keys = ["query_id", *match, *visible.carry]
    # Written first, so that Spark plans with the true size.
    wanted = durable(query_terms(queries, index, keys[1:], stop_words, variant))
    asked, wanted = _numbered(wanted, keys, "_q")
    need, wanted = _numbered(wanted, ["term", *keys[1:]], "_no")
    wanted = durable(wanted.drop(*keys))
    search = lambda some, k: _cells(some, _hits(some, need, index, match, variant, visible), index, k)
    scores = _pruned_scores(wanted, index, variant, k, seed_postings, search) if prune else search(wanted, k)
    scores = scores.join(asked, "_q").select(*keys, index.id_col, F.round("score", 6).alias("score"))
    return top_rows(scores, keys, [F.desc("score"), F.asc(index.id_col)], k)


def _pruned_scores(wanted: DataFrame, index: SparseIndex, variant: str, k: int, seed_postings: int, search: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """Exact dynamic pruning in three joins.

    1. Rare terms alone give each query ``k`` candidates; the k-th partial score is a floor for the true k-th score.
    2. Common terms whose best scores together stay below the floor cannot lift a chunk on their own,
       so only chunks with another term are candidates.
    3. Candidates whose upper bound still reaches the floor are scored in full from their own term counts.
    """
    by_rarity = Window.partitionBy("_q").orderBy("df", "term")
    cost = F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, 0))
    seeds = wanted.withColumn("_cost", cost).withColumn("_no_of", F.row_number().over(by_rarity))
    seeds = seeds.where((F.col("_cost") <= seed_postings) | (F.col("_no_of") == 1)).drop("_cost", "_no_of")

    def kth(found: DataFrame, name: str) -> DataFrame:
        best = top_rows(found, ["_q"], [F.desc("score"), F.asc(index.id_col)], k)
        # Scores are rounded before ranking, so the floor gives way by one rounding step.
        return best.groupBy("_q").agg(F.when(F.count("*") == k, F.min("score") - 1e-5).alias(name))

    by_bound = Window.partitionBy("_q").orderBy("top_score", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = durable(
        wanted.join(kth(search(durable(seeds), k), "floor"), "_q", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("reach", F.sum("top_score").over(by_bound))
        # Half the floor is left as slack, so that most candidates fail the bound below.
        .withColumn("essential", F.col("reach") >= F.col("floor") / 2)
    )
    slack = bounded.groupBy("_q").agg(
        F.first("floor").alias("floor"),
        F.coalesce(F.sum(F.when(~F.col("essential"), F.col("top_score"))), F.lit(0.0)).alias("slack"),
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("query"),
    )
    essential = durable(bounded.where("essential").select("_q", "_no", "weight"))
    # The candidates' own partial scores raise the floor once more.
    slack = durable(slack.join(kth(search(essential, k), "better"), "_q", "left").withColumn("floor", F.greatest("floor", "better")).drop("better"))
    least = slack.select("_q", (F.col("floor") - F.col("slack")).alias("least"))
    # Written, so that Spark knows how few they are and moves them to the chunks, not the chunks to them.
    candidates = durable(search(durable(essential.join(least, "_q")), None).drop("score"))
    asked = slack.select("_q", "query", index.corpus.select("avgdl").scalar().alias("avgdl"))
    full = candidates.join(index.forward.select(index.id_col, "dl", "counts"), index.id_col).join(asked, "_q")

    def part(hit: Column) -> Column:
        weight = F.element_at(F.col("query"), hit["term"])
        return F.coalesce(weight, F.lit(0.0)) * saturation(hit["tf"], F.col("dl"), F.col("avgdl"), variant)

    score = F.aggregate("counts", F.lit(0.0), lambda acc, hit: acc + part(hit))
    return full.select("_q", index.id_col, score.alias("score"))
