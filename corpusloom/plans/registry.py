"""Named queries over the given tables and, where one exists, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.functions.text import STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the tables every plan derives from them. Reads are lazy and prune columns."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("file_id"), "text", "lang", F.col("source").alias("scope_id"), "n_chars"
        )

    def parents(self) -> DataFrame:
        return chunking.window_parents(self.files().drop("n_chars"))

    def children(self) -> DataFrame:
        return chunking.window_children(self.parents())

    def passages(self) -> DataFrame:
        """The benchmark passages as queries."""
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def scoped_passages(self) -> DataFrame:
        """Every passage asked once in each language scope of the documents; there are as many scopes as languages."""
        scopes = sorted(r["lang"] for r in self.documents.where("lang is not null").select("lang").distinct().collect())
        langs = F.explode(F.array(*[F.lit(x) for x in scopes]).cast("array<string>"))
        return self.passages().select("query_id", langs.alias("lang"), "text")

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("child_id"), "embedding", F.col("label").alias("file_id"))

    def vector_queries(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("file_id"))

    def turns(self) -> DataFrame:
        role = F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
        return self.conversations.select("conv_id", F.col("turn"), role.alias("role"), "text")


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# --- the derived tables in SQL -------------------------------------------------------------------------------

PARENTS_SQL = """parents AS (
  SELECT doc_id AS file_id, lang, source AS scope_id, i::INTEGER AS parent_index,
         substr(text, i * 880 + 1, 1000) AS text, doc_id::VARCHAR || ':' || i AS parent_id
  FROM (SELECT *, unnest(range(0, (greatest(length(text) - 120, 1) - 1) // 880 + 1)) AS i FROM documents))"""

CHILDREN_SQL = PARENTS_SQL + """,
children AS (
  SELECT file_id, lang, scope_id, parent_index, parent_id, i::INTEGER AS child_index, (i * 206)::INTEGER AS start_index,
         substr(text, i * 206 + 1, 256) AS text, parent_id || ':' || i AS child_id
  FROM (SELECT *, unnest(range(0, (greatest(length(text) - 50, 1) - 1) // 206 + 1)) AS i FROM parents))"""

STOP_SQL = ", ".join("'" + w + "'" for w in STOP_WORDS)


def terms_sql(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda x: length(x) >= 2 AND x NOT IN ({STOP_SQL}))"
    )


INDEX_SQL = CHILDREN_SQL + f""",
toks AS (SELECT child_id, parent_id, file_id, lang, t AS tokens FROM (
  SELECT *, {terms_sql('text')} AS t FROM children) WHERE len(t) > 0),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM toks),
postings AS (SELECT term, child_id, lang, count(*) AS tf, any_value(dl) AS dl FROM (
  SELECT child_id, lang, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY term, child_id, lang),
term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def bm25_sql(name: str, k: int, scoped: bool, formula: str = "tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))",
             idf: str = "ln(1 + (n - df + 0.5) / (df + 0.5))") -> str:
    """CTEs ending in ``name``(query_id[, lang], child_id, score, rank)."""
    scope = ", lang" if scoped else ""
    source = (
        "(SELECT item_id AS query_id, text, unnest((SELECT list(DISTINCT lang) FROM documents WHERE lang IS NOT NULL)) AS lang FROM benchmark)"
        if scoped
        else "(SELECT item_id AS query_id, text FROM benchmark)"
    )
    return f""",
{name}_terms AS (SELECT query_id{scope}, term, count(*) AS qtf FROM (
  SELECT query_id{scope}, unnest({terms_sql('text')}) AS term FROM {source}) GROUP BY ALL),
{name}_scores AS (SELECT query_id{", p.lang AS lang" if scoped else ""}, child_id,
    round(sum(qtf * {idf} * ({formula})), 6) AS score
  FROM {name}_terms q JOIN postings p ON q.term = p.term {"AND q.lang = p.lang" if scoped else ""}
  JOIN term_stats s ON s.term = p.term, corpus GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id{scope} ORDER BY score DESC, child_id)::INTEGER AS rank
  FROM {name}_scores) WHERE rank <= {k})"""


LETTERS_SQL = "[" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
