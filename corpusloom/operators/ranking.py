"""From ranked chunk lists to a context: fusion, parent backtracking, gate, rerank, assembly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import terms
from corpusloom.operators.running import ranked_rows, top_rows
from corpusloom.session import few

RRF_C = 60
MAX_K = 50
FINAL_K, MAX_CANDIDATES, TOP_N = 8, 20, 7
EMPTY_CONTEXT = "未检索到相关文档。"
# Metadata keys a model gets to see.
KEPT_METADATA = ("file_id", "file_extension", "parent_index", "Header 1")


def adaptive_k(children: DataFrame, keys: Sequence[str], final_k: int = FINAL_K, count: Column | None = None) -> DataFrame:
    """Search depths of each scope from its number of children; ``count`` is that number where a row stands for several."""
    n = F.count("*") if count is None else count
    k = F.least(F.lit(MAX_K), F.greatest(F.lit(10), F.ceil(n * 0.1))).cast("int")
    return (
        children.groupBy(*keys)
        .agg(n.alias("children"), k.alias("k"))
        .withColumn("fetch_k", F.least("children", F.col("k") * 3).cast("int"))
        .withColumn("rrf_k", F.ceil(F.col("k") * 0.5).cast("int"))
        .withColumn("final_k", F.lit(final_k))
    )


def with_overrides(queries: DataFrame, depths: DataFrame, key: str) -> DataFrame:
    """A query's own ``k_override`` wins over its scope's ``k``."""
    return queries.join(depths, key).withColumn("k", F.coalesce("k_override", "k"))


def cut(ranked: DataFrame, depths: DataFrame, keys: Sequence[str], depth: str) -> DataFrame:
    """Keep ranks up to a per-scope depth."""
    small = depths.select(*keys, F.col(depth).alias("_depth"))
    return ranked.join(small, list(keys)).where(F.col("rank") <= F.col("_depth")).drop("_depth")


def fuse(lists: Sequence[tuple[DataFrame, float]], keys: Sequence[str], id_col: str = "child_id", upper: int | None = None, c: int = RRF_C) -> DataFrame:
    """Weighted reciprocal-rank fusion. Equal scores keep the order of first appearance (list, then rank).

    Every id of the lists is ranked. ``upper`` cuts the result where the caller wants fewer, or states how many there can be.
    """
    parts = [
        df.select(*keys, id_col, "rank", F.lit(weight).alias("w"), F.lit(no).alias("list_no"))
        for no, (df, weight) in enumerate(lists)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fused = every.groupBy(*keys, id_col).agg(
        F.round(F.sum(F.col("w") / (F.col("rank") + c)), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first_seen")
    )
    order = [F.desc("score"), F.asc("first_seen.list_no"), F.asc("first_seen.rank"), F.asc(id_col)]
    return ranked_rows(fused, keys, order, upper).drop("first_seen")


def backtrack(ranked: DataFrame, links: DataFrame, keys: Sequence[str], child: str = "child_id", parent: str = "parent_id", upper: int | None = None) -> DataFrame:
    """Ranked children to ranked parents: first occurrence counts, unknown children drop out. Ids only, no text."""
    joined = few(ranked.select(*keys, child, "rank")).join(links.select(child, parent), child)
    first = joined.groupBy(*keys, parent).agg(F.min("rank").alias("first_rank"))
    return ranked_rows(first, keys, [F.asc("first_rank"), F.asc(parent)], upper).drop("first_rank")


def overlap_score(query: Column, text: Column) -> Column:
    """Deterministic stand-in for a reranking model: share of the query's distinct terms found in the text."""
    wanted = F.array_distinct(terms(query))
    return F.round(F.size(F.array_intersect(wanted, terms(text))) / F.greatest(F.size(wanted), F.lit(1)), 6)


def yes_probability(yes: Column, no: Column) -> Column:
    """Two-way softmax of a model's yes and no logits."""
    return 1 / (1 + F.exp(no - yes))


def rerank(
    parents: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    scorer: Callable[[Column, Column], Column] = overlap_score,
    *,
    parent: str = "parent_id",
    enabled: bool = True,
    final_k: int = FINAL_K,
    max_candidates: int = MAX_CANDIDATES,
    top_n: int = TOP_N,
) -> DataFrame:
    """Gate, then rescore: queries with at most ``final_k`` parents pass unchanged, the others have their first
    ``max_candidates`` rescored and keep ``top_n``. The cap sits below the scorer, so a model sees no other row."""
    counts = parents.groupBy(*keys).agg(F.count("*").alias("_n"))
    counted = parents.join(counts, list(keys))
    gate = F.lit(enabled) & (F.col("_n") > final_k)
    passed = counted.where(~gate & (F.col("rank") <= final_k)).select(
        *keys, parent, F.col("rank"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("reranked")
    )
    pool = counted.where(gate & (F.col("rank") <= max_candidates))
    pool = few(pool).join(texts.select(parent, F.col("text").alias("_text")), parent)
    pool = pool.join(queries.select(*keys, F.col("text").alias("_query")).distinct(), list(keys))
    scored = pool.select(*keys, parent, F.col("rank").alias("_old"), scorer(F.col("_query"), F.col("_text")).alias("score"))
    best = top_rows(scored, keys, [F.desc("score"), F.asc("_old")], top_n).select(
        *keys, parent, "rank", "score", F.lit(True).alias("reranked")
    )
    return passed.unionByName(best)


def first_n(ranked: DataFrame, n: int) -> DataFrame:
    """Pass-through compressor."""
    return ranked.where(F.col("rank") <= n)


def visible(metadata: Column, keys: Sequence[str] = KEPT_METADATA) -> Column:
    return F.map_filter(metadata, lambda k, _: k.isin(*keys))


def context_block(metadata: Column, text: Column) -> Column:
    return F.concat(F.lit("Metadata: "), metadata, F.lit("\nContent: "), text)


def assemble(ranked: DataFrame, keys: Sequence[str], block: str = "block") -> DataFrame:
    """One context per query from its final, hence few, blocks in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", block)))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s[block]), "\n\n").alias("context"))


def with_empty_context(queries: DataFrame, contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = queries.select(*keys).join(contexts, list(keys), "left")
    return joined.withColumn("context", F.coalesce("context", F.lit(EMPTY_CONTEXT)))


def first_seen(ranked: DataFrame, keys: Sequence[str], id_col: str, round_col: str = "round") -> DataFrame:
    """Union of the retrieval rounds of a request: each id once, ordered by first round and rank."""
    seen = ranked.groupBy(*keys, id_col).agg(F.min(F.struct(round_col, "rank")).alias("_at"))
    return seen.select(*keys, id_col, F.col(f"_at.{round_col}").alias("first_round"), F.col("_at.rank").alias("first_rank"))
