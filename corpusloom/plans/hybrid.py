"""Registered queries: search within overlapping scopes of files, under metadata filters, with MMR and own depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import hybrid, scoring
from corpusloom.plans.registry import CHILDREN_SQL, INDEX_SQL, LETTERS_SQL, Tables, query, terms_sql
from corpusloom.plans.search import OVERLAP_SQL
from corpusloom.session import few

#: Scopes of several files; French files are in two, approved ones may be in three.
SCOPES_SQL = """scopes AS (SELECT 'west' AS scope_id, doc_id AS file_id FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT 'inland', doc_id FROM documents WHERE lang IN ('de', 'fr')
  UNION ALL SELECT 'approved', doc_id FROM labels WHERE quality = 1)"""
SCOPE_IDS = ("west", "inland", "approved")
FILTERS = {
    "beginnings": {"parent_index": {"lt": 2}, "lang": ["en", "fr"]},
    "known origin": {"n_chars": {"gte": 800, "lt": 20000}, "source": {"exists": True}, "child_index": 1},
}
FILTERS_SQL = """(filter_id IS NULL OR filter_id = 'beginnings' AND parent_index < 2 AND lang IN ('en', 'fr')
  OR filter_id = 'known origin' AND n_chars >= 800 AND n_chars < 20000 AND source IS NOT NULL AND child_index = 1)"""
FILTER_SQL = "CASE item_id % 3 WHEN 1 THEN 'beginnings' WHEN 2 THEN 'known origin' END"


def scopes(t: Tables) -> DataFrame:
    named = lambda scope, rows: rows.select(F.lit(scope).alias("scope_id"), F.col("doc_id").alias("file_id"))
    west, inland = (named(s, t.documents.where(F.col("lang").isin(*langs))) for s, langs in (("west", ("en", "fr")), ("inland", ("de", "fr"))))
    return west.unionByName(inland).unionByName(named("approved", t.labels.where("quality = 1")))


def corpus(t: Tables, filters=FILTERS) -> hybrid.Corpus:
    about = t.documents.select(F.col("doc_id").alias("file_id"), "n_chars", "source")
    return hybrid.corpus(t.children().join(about, "file_id"), scopes(t), filters=filters)


def questions(t: Tables, filter_id: Column | None = None, k_override: Column | None = None) -> DataFrame:
    """Every passage in every scope; which filter and depth it has depends on the passage."""
    named = F.explode(F.array(*[F.lit(s) for s in SCOPE_IDS])).alias("scope_id")
    none = F.lit(None)
    return t.benchmark.select(
        F.col("item_id").alias("query_id"), named, "text",
        (none.cast("string") if filter_id is None else filter_id).alias("filter_id"), (none.cast("int") if k_override is None else k_override).alias("k_override"),
    )


def own_filter() -> Column:
    return F.when(F.col("item_id") % 3 == 1, "beginnings").when(F.col("item_id") % 3 == 2, "known origin")


def asked_sql(filter_id: str = "NULL", k_override: str = "NULL") -> str:
    """CTEs up to ``visible``(query_id, scope_id, child_id): what each question may see."""
    return f"""{INDEX_SQL}, {SCOPES_SQL},
q AS (SELECT item_id AS query_id, text, unnest({list(SCOPE_IDS)}) AS scope_id, {filter_id} AS filter_id, ({k_override})::INTEGER AS k_override FROM benchmark),
sizes AS (SELECT s.scope_id, count(*) AS n, least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE)))::INTEGER AS own_k FROM scopes s JOIN children c ON c.file_id = s.file_id GROUP BY 1),
asked AS (SELECT q.*, coalesce(k_override, own_k) AS k, least(n, 3 * own_k)::INTEGER AS fetch_k, ceil(own_k * 0.5::DOUBLE)::INTEGER AS rrf_k FROM q JOIN sizes USING (scope_id)),
described AS (SELECT c.*, d.n_chars, d.source FROM children c JOIN documents d ON d.doc_id = c.file_id),
parts AS (SELECT DISTINCT scope_id, filter_id FROM asked),
visible AS (SELECT s.scope_id, p.filter_id, c.child_id, c.text FROM described c JOIN scopes s ON s.file_id = c.file_id JOIN parts p ON p.scope_id = s.scope_id WHERE {FILTERS_SQL})"""


BM25_SQL = f""",
b_terms AS (SELECT query_id, scope_id, filter_id, k, term, count(*) AS qtf FROM (SELECT *, unnest({terms_sql('text')}) AS term FROM asked) GROUP BY ALL),
b_scores AS (SELECT b.query_id, b.scope_id, b.k, p.child_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM b_terms b JOIN postings p ON p.term = b.term JOIN term_stats s ON s.term = p.term
  JOIN visible v ON v.child_id = p.child_id AND v.scope_id = b.scope_id AND v.filter_id IS NOT DISTINCT FROM b.filter_id, corpus GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY score DESC, child_id)::INTEGER AS rank FROM b_scores) WHERE rank <= k)"""

NEAR_SQL = f""",
emb AS (SELECT child_id, scope_id, filter_id, {LETTERS_SQL}::DOUBLE[26] AS vec FROM visible),
qemb AS (SELECT *, {LETTERS_SQL}::DOUBLE[26] AS qvec FROM asked),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY score DESC, child_id)::INTEGER AS rank FROM (
  SELECT query_id, q.scope_id, child_id, vec, qvec, k, fetch_k, round(array_cosine_similarity(qvec, vec), 9) AS score
  FROM qemb q JOIN emb e ON e.scope_id = q.scope_id AND e.filter_id IS NOT DISTINCT FROM q.filter_id
  WHERE list_sum(vec::DOUBLE[]) > 0 AND list_sum(qvec::DOUBLE[]) > 0))"""

#: Every candidate keeps its largest similarity to those taken; each step marks the best one of each question.
MMR_SQL = NEAR_SQL + """,
steps AS (
  SELECT query_id, scope_id, child_id, vec, k, rank, score AS rel, score AS gain, -2::DOUBLE AS closest, true AS open, 0 AS step, '' AS pick FROM near WHERE rank <= fetch_k
  UNION ALL
  SELECT query_id, scope_id, child_id, vec, k, rank, rel, round(0.5::DOUBLE * rel - 0.5::DOUBLE * near_now, 9), near_now, open AND child_id <> pick, step + 1, pick FROM (
    SELECT * EXCLUDE (pick, pvec), ppick AS pick, greatest(closest, round(array_cosine_similarity(pvec, vec), 9)) AS near_now FROM (
      SELECT *, first_value(child_id) OVER w AS ppick, first_value(vec) OVER w AS pvec FROM steps WHERE step < k
      WINDOW w AS (PARTITION BY query_id, scope_id ORDER BY open DESC, gain DESC, rank)))
    WHERE step < (SELECT max(k) FROM asked)),
picks AS (SELECT query_id, scope_id, step AS rank, pick AS child_id, count(*) AS candidates FROM steps WHERE step > 0 GROUP BY ALL),
d AS (SELECT query_id, scope_id, child_id, rank FROM picks WHERE rank <= candidates)"""

FUSED_SQL = """,
lists AS (SELECT query_id, scope_id, child_id, rank, 0 AS no FROM b UNION ALL SELECT query_id, scope_id, child_id, rank, 1 FROM d),
fused AS (SELECT query_id, scope_id, child_id, score, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY score DESC, no, first_rank, child_id)::INTEGER AS rank
  FROM (SELECT query_id, scope_id, child_id, round(sum(0.5::DOUBLE / (rank + 60)), 9) AS score, min(no) AS no, min_by(rank, no) AS first_rank FROM lists GROUP BY ALL))"""

FINAL_SQL = FUSED_SQL + f""",
firsts AS (SELECT f.query_id, f.scope_id, parent_id, min(rank) AS first_rank FROM fused f JOIN asked a ON a.query_id = f.query_id AND a.scope_id = f.scope_id
  JOIN children c USING (child_id) WHERE rank <= rrf_k GROUP BY ALL),
parent_list AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY first_rank, parent_id)::INTEGER AS rank, count(*) OVER (PARTITION BY query_id, scope_id) AS n FROM firsts),
rescored AS (SELECT g.query_id, g.scope_id, g.parent_id, g.rank AS old, {OVERLAP_SQL} AS score
  FROM parent_list g JOIN benchmark q ON q.item_id = g.query_id JOIN parents p ON p.parent_id = g.parent_id WHERE n > 8 AND rank <= 20),
final AS (SELECT query_id, scope_id, parent_id, rank, NULL::DOUBLE AS score, false AS reranked FROM parent_list WHERE n <= 8
  UNION ALL SELECT query_id, scope_id, parent_id, rank, score, true FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, scope_id ORDER BY score DESC, old)::INTEGER AS rank FROM rescored) WHERE rank <= 7)"""


@query("search_file_scope", f"WITH {asked_sql()}{BM25_SQL} SELECT query_id, scope_id, child_id, score, rank FROM b")
def search_file_scope(t: Tables) -> DataFrame:
    """Terms, within scopes that share files."""
    within = corpus(t, {})
    return hybrid.term_list(hybrid.ask(questions(t), within), within)


@query("bm25_metadata_filter", f"WITH {asked_sql(FILTER_SQL)}{BM25_SQL} SELECT query_id, scope_id, child_id, score, rank FROM b")
def bm25_metadata_filter(t: Tables) -> DataFrame:
    """Terms, where two in three questions carry a filter: any of, ranges, existence, equality."""
    within = corpus(t)
    return hybrid.term_list(hybrid.ask(questions(t, own_filter()), within), within)


@query("dense_metadata_filter", f"WITH {asked_sql(FILTER_SQL)}{NEAR_SQL} SELECT query_id, scope_id, child_id, round(score, 6) AS score, rank FROM near WHERE rank <= k")
def dense_metadata_filter(t: Tables) -> DataFrame:
    """The same questions by vector."""
    within = corpus(t)
    found = hybrid.vector_list(hybrid.ask(questions(t, own_filter()), within), within, semantic="similarity")
    return found.withColumn("score", F.round("score", 6))


@query("dense_mmr", f"WITH RECURSIVE {asked_sql(FILTER_SQL)}{MMR_SQL} SELECT query_id, scope_id, child_id, rank FROM d")
def dense_mmr(t: Tables) -> DataFrame:
    """The nearest ``fetch_k`` children of each question, and of them the ``k`` that are near it and unlike each other."""
    within = corpus(t)
    return hybrid.vector_list(hybrid.ask(questions(t, own_filter()), within), within)


@query("hybrid_mmr", f"WITH RECURSIVE {asked_sql(FILTER_SQL)}{BM25_SQL}{MMR_SQL}{FINAL_SQL} SELECT query_id, scope_id, parent_id, rank, score, reranked FROM final")
def hybrid_mmr(t: Tables) -> DataFrame:
    """The whole search: terms and MMR in scopes and under filters, fused, led back to parents, reranked."""
    return hybrid.search(questions(t, own_filter()), corpus(t), t.parents())


OVERRIDE_SQL = "CASE WHEN length(text) < 200 THEN 4 WHEN item_id % 4 = 0 THEN 70 END"


@query("hybrid_k_override", f"WITH RECURSIVE {asked_sql(k_override=OVERRIDE_SQL)}{BM25_SQL}{MMR_SQL}{FUSED_SQL} SELECT query_id, scope_id, child_id, round(score, 6) AS score, rank FROM fused")
def hybrid_k_override(t: Tables) -> DataFrame:
    """Fused lists of questions of which some bring a depth of their own, smaller or larger than any scope's."""
    within = corpus(t, {})
    own = F.when(F.length("text") < 200, 4).when(F.col("item_id") % 4 == 0, 70)
    return hybrid.fused(hybrid.ask(questions(t, k_override=own), within), within).withColumn("score", F.round("score", 6))


@query("search_records", f"""WITH RECURSIVE {asked_sql(FILTER_SQL)}{BM25_SQL}{MMR_SQL}{FINAL_SQL},
r AS (SELECT f.query_id, f.scope_id, list(f.parent_id ORDER BY rank) AS ids, list(p.file_id ORDER BY rank) AS files, string_agg(p.text, chr(30) ORDER BY rank) AS contexts
  FROM final f JOIN parents p ON p.parent_id = f.parent_id GROUP BY ALL)
SELECT q.query_id, q.scope_id, coalesce(array_to_string(ids, '|'), '') AS doc_ids, coalesce(array_to_string(list_filter(files, lambda x, i: list_position(files, x) = i), '|'), '') AS file_ids,
  md5(coalesce(contexts, '')) AS contexts_md5, CASE WHEN ids IS NULL THEN 'empty' ELSE 'success' END AS status FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.scope_id = q.scope_id""")
def search_records(t: Tables) -> DataFrame:
    """What a run of the whole search keeps of each question: ids, files and texts in rank order."""
    asked = questions(t, own_filter()).withColumn("sample_id", F.struct(*hybrid.KEYS))
    found = hybrid.search(asked.drop("sample_id"), corpus(t), t.parents())
    ranked = few(found).join(t.parents().select("parent_id", "file_id", "text"), "parent_id").withColumn("sample_id", F.struct(*hybrid.KEYS))
    records = scoring.run_records(asked.select("sample_id", *hybrid.KEYS), ranked, id_col="parent_id", also={"actual_file_ids": "file_id", "actual_contexts": "text"})
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    contexts = F.md5(F.array_join("actual_contexts", "\x1e"))
    return records.select(*hybrid.KEYS, joined("actual_doc_ids").alias("doc_ids"), joined("actual_file_ids").alias("file_ids"), contexts.alias("contexts_md5"), "status")
