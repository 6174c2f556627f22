"""Registered queries: an index after files were replaced and deleted, against one built anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunking, dense, index_table, sparse
from corpusloom.plans.registry import INDEX_SQL, LETTERS_SQL, Tables, bm25_sql, query
from corpusloom.sources.tables import scratch

PARENT_TEXT = "substr(text, i * 880 + 1, 1000) AS text"
REPLACED_SQL = INDEX_SQL.replace(PARENT_TEXT, f"{PARENT_TEXT[:-8]} || CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN ' second write' ELSE '' END AS text")
CHANGED_SQL = REPLACED_SQL.replace("FROM documents))", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)))")
assert CHANGED_SQL != REPLACED_SQL != INDEX_SQL


def stored(t: Tables, replace: bool = True, delete: bool = True) -> index_table.IndexTable:
    """An index of all files, then approved files written a second time and toxic ones deleted."""
    index = index_table.IndexTable(scratch(t.spark), keep="file_id bigint, embedding array<double>")
    labels = t.labels.select(F.col("doc_id").alias("file_id"), "quality", "toxic")

    def chunks(parents: DataFrame) -> DataFrame:
        return dense.embed(chunking.window_children(index_table.deal(index, parents)), "text", dense.letter_embedding)

    index_table.create(index, chunks(t.parents()), dealt=True)
    if replace:
        again = t.parents().join(labels.where("quality = 1").select("file_id"), "file_id", "left_semi")
        index_table.change(index, "replace", chunks(again.withColumn("text", F.concat("text", F.lit(" second write")))), dealt=True)
    if delete:
        gone = t.parents().join(labels.where("toxic = 1").select("file_id"), "file_id", "left_semi")
        index_table.change(index, "delete", deleted=gone.select("parent_id"))
    return index


@query("index_replace", f"WITH {REPLACED_SQL} SELECT term, child_id, tf, dl FROM postings")
def index_replace(t: Tables) -> DataFrame:
    """Postings after approved files were written again under their old ids."""
    return index_table.searchable(stored(t, delete=False), t.spark).postings.select("term", "child_id", "tf", "dl")


@query("index_delete", f"WITH {CHANGED_SQL} SELECT term, df, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM term_stats, corpus")
def index_delete(t: Tables) -> DataFrame:
    """Statistics after replacing and deleting; they come from differences only."""
    index = index_table.searchable(stored(t), t.spark)
    n, avgdl = (index.corpus.select(c).scalar() for c in ("n", "avgdl"))
    return index.term_stats.select("term", "df", n.alias("n"), F.round(avgdl, 6).alias("avgdl"))


@query("index_search", f"WITH {CHANGED_SQL}{bm25_sql('b', 8, False)} SELECT query_id, child_id, score, rank FROM b")
def index_search(t: Tables) -> DataFrame:
    return sparse.bm25(t.passages(), index_table.searchable(stored(t), t.spark), 8).select("query_id", "child_id", "score", "rank")


@query("index_vectors", f"""WITH {CHANGED_SQL}, e AS (SELECT child_id, {LETTERS_SQL}::DOUBLE[26] AS vec FROM children), q AS (SELECT item_id AS query_id, {LETTERS_SQL}::DOUBLE[26] AS qvec FROM benchmark),
s AS (SELECT query_id, child_id, round(array_cosine_similarity(qvec, vec), 9) AS score FROM q, e WHERE list_sum(vec::DOUBLE[]) > 0 AND list_sum(qvec::DOUBLE[]) > 0)
SELECT query_id, child_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def index_vectors(t: Tables) -> DataFrame:
    vectors = stored(t).forward(t.spark).select("child_id", "embedding")
    found = dense.nearest(dense.embed(t.passages(), "text", dense.letter_embedding), vectors, 5, metric="dot")
    return found.withColumn("score", F.round("score", 6))
