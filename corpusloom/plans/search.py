"""Registered queries: tokens, postings, BM25, nearest neighbours, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions.text import terms, words
from corpusloom.operators import dense, ranking, sparse
from corpusloom.session import durable, few
from corpusloom.plans.registry import (
    CHILDREN_SQL, INDEX_SQL, LETTERS_SQL, PARENTS_SQL, Tables, bm25_sql, query, terms_sql,
)


@query("tokens", f"""
SELECT doc_id AS file_id, len({terms_sql('text')}) AS term_count, len(list_distinct({terms_sql('text')})) AS distinct_terms,
       array_to_string({terms_sql('text')}, ' ') AS terms FROM documents""")
def tokens(t: Tables) -> DataFrame:
    found = t.files().select("file_id", terms(F.col("text")).alias("t"))
    return found.select(
        "file_id", F.size("t").alias("term_count"), F.size(F.array_distinct("t")).alias("distinct_terms"),
        F.array_join("t", " ").alias("terms"),
    )


def child_index(t: Tables, variant: str = "lucene") -> sparse.SparseIndex:
    return sparse.build_index(t.children(), keep=("lang",), variant=variant)


@query("postings", f"WITH {INDEX_SQL} SELECT term, child_id, tf, dl FROM postings")
def postings(t: Tables) -> DataFrame:
    return child_index(t).postings.select("term", "child_id", "tf", "dl")


@query("term_stats", f"WITH {INDEX_SQL} SELECT term, df, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM term_stats, corpus")
def term_stats(t: Tables) -> DataFrame:
    index = child_index(t)
    return index.term_stats.select(
        "term", "df", index.corpus.select("n").scalar().alias("n"), F.round(index.corpus.select("avgdl").scalar(), 6).alias("avgdl")
    )


@query("bm25_topk", f"WITH {INDEX_SQL}{bm25_sql('b', 8, False)} SELECT query_id, child_id, score, rank FROM b")
def bm25_topk(t: Tables) -> DataFrame:
    return sparse.bm25(t.passages(), child_index(t), 8).select("query_id", "child_id", "score", "rank")


@query("bm25_pruned", f"WITH {INDEX_SQL}{bm25_sql('b', 8, False)} SELECT query_id, child_id, score, rank FROM b")
def bm25_pruned(t: Tables) -> DataFrame:
    return sparse.bm25(t.passages(), child_index(t), 8, prune=True).select("query_id", "child_id", "score", "rank")


@query("bm25_filtered", f"WITH {INDEX_SQL}{bm25_sql('b', 8, True)} SELECT query_id, lang, child_id, score, rank FROM b")
def bm25_filtered(t: Tables) -> DataFrame:
    found = sparse.bm25(t.scoped_passages(), child_index(t), 8, match={"lang": "lang"})
    return found.select("query_id", "lang", "child_id", "score", "rank")


OKAPI_IDF = "(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25 * (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) FROM term_stats, corpus) ELSE ln((n - df + 0.5) / (df + 0.5)) END)"


@query("bm25_okapi", f"""WITH {INDEX_SQL}{bm25_sql('b', 30, False, 'tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))', OKAPI_IDF)}
SELECT query_id, child_id, score, rank FROM b""")
def bm25_okapi(t: Tables) -> DataFrame:
    found = sparse.bm25(t.passages(), child_index(t, "okapi"), 30, variant="okapi")
    return found.select("query_id", "child_id", "score", "rank")


@query("bm25_plus", f"""WITH {INDEX_SQL}{bm25_sql('b', 8, False, '1 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))', 'ln((n + 1) / df)')}
SELECT query_id, child_id, score, rank FROM b""")
def bm25_plus(t: Tables) -> DataFrame:
    found = sparse.bm25(t.passages(), child_index(t, "plus"), 8, variant="plus")
    return found.select("query_id", "child_id", "score", "rank")


# --- vectors -------------------------------------------------------------------------------------------------

PAIRS_SQL = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS child_id, q.label AS file_id,
  {score} AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id {scope})"""
RANKED_SQL = """SELECT query_id, child_id, round(round(score, 9), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, child_id)::INTEGER AS rank FROM pairs {where})
  WHERE rank <= {k}"""
V = "{0}.embedding::DOUBLE[64]"
COSINE_SQL = "array_cosine_similarity(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64])"
L2_SQL = "-power(array_distance(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64]), 2)"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "child_id", F.round("score", 6).alias("score"), "rank")


@query("knn_cosine", "WITH " + PAIRS_SQL.format(score=COSINE_SQL, scope="") + RANKED_SQL.format(where="", k=10))
def knn_cosine(t: Tables) -> DataFrame:
    return rounded(dense.nearest(t.vector_queries(), t.vectors(), 10, metric="cosine", skip_self=True), "query_id")


@query("knn_l2", "WITH " + PAIRS_SQL.format(score=L2_SQL, scope="AND q.label = c.label") + RANKED_SQL.format(where="", k=10))
def knn_l2(t: Tables) -> DataFrame:
    found = dense.nearest(t.vector_queries(), t.vectors(), 10, metric="l2", part=["file_id"], skip_self=True)
    return rounded(found, "query_id")


@query("knn_threshold", "WITH " + PAIRS_SQL.format(score=COSINE_SQL, scope="") + RANKED_SQL.format(where="WHERE round(score, 9) >= 0.3", k=10))
def knn_threshold(t: Tables) -> DataFrame:
    found = dense.nearest(t.vector_queries(), t.vectors(), 10, metric="cosine", skip_self=True, min_score=0.3)
    return rounded(found, "query_id")


@query("knn_approximate")
def knn_approximate(t: Tables) -> DataFrame:
    found = dense.approximate(t.vector_queries(), t.vectors(), 10, 64, skip_self=True)
    return rounded(found, "query_id")


@query("mmr", "WITH RECURSIVE " + PAIRS_SQL.format(score=L2_SQL, scope="") + """,
fetched AS (SELECT f.query_id, f.child_id, rank, round(array_cosine_similarity(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64]), 9) AS rel,
    c.embedding::DOUBLE[64] AS vec
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, child_id) AS rank FROM pairs) f
  JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings c ON c.vec_id = f.child_id WHERE rank <= 15),
steps AS (
  SELECT query_id, child_id, vec, 1 AS step, [child_id] AS chosen, [vec] AS vecs FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS r FROM fetched) WHERE r = 1
  UNION ALL
  SELECT query_id, child_id, vec, step + 1, list_append(chosen, child_id), list_append(vecs, vec) FROM (
    SELECT f.query_id, f.child_id, f.vec, s.step, s.chosen, s.vecs, row_number() OVER (PARTITION BY f.query_id ORDER BY
      round(0.5::DOUBLE * rel - 0.5::DOUBLE * list_max(list_transform(s.vecs, lambda v: round(array_cosine_similarity(v, f.vec), 9))), 9) DESC, rank) AS r
    FROM steps s JOIN fetched f ON f.query_id = s.query_id WHERE NOT list_contains(s.chosen, f.child_id) AND s.step < 5) WHERE r = 1)
SELECT query_id, child_id, step AS rank FROM steps""")
def mmr(t: Tables) -> DataFrame:
    return dense.mmr_search(t.vector_queries(), t.vectors(), 5, 15, metric="l2", skip_self=True)


@query("mixed_models", """WITH s AS (SELECT label AS model, len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY ALL),
m AS (SELECT model, max_by(dim, n) AS main_dim FROM s GROUP BY model)
SELECT s.model, dim, n, dim <> main_dim AS rejected FROM s JOIN m USING (model)""")
def mixed_models(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("label").alias("model"), "embedding")
    rejects = dense.mixed_models(v).groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("bad"))
    sizes = v.groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    return sizes.join(rejects, ["model", "dim"], "left").select("model", "dim", "n", F.col("bad").isNotNull().alias("rejected"))


EMBED_SQL = """emb AS (SELECT child_id, lang, {letters}::DOUBLE[26] AS vec FROM children),
qemb AS (SELECT item_id AS query_id, {letters}::DOUBLE[26] AS vec FROM benchmark)""".format(letters=LETTERS_SQL)
DENSE_SQL = EMBED_SQL + """,
d_scores AS (SELECT q.query_id, l.lang AS lang, e.child_id, round(array_cosine_similarity(q.vec, e.vec), 9) AS score
  FROM qemb q, (SELECT unnest((SELECT list(DISTINCT lang) FROM documents WHERE lang IS NOT NULL)) AS lang) l JOIN emb e ON e.lang = l.lang
  WHERE list_sum(e.vec::DOUBLE[]) > 0 AND list_sum(q.vec::DOUBLE[]) > 0),
d_all AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, child_id)::INTEGER AS rank FROM d_scores)"""


def with_letters(df: DataFrame) -> DataFrame:
    return dense.embed(df, "text", dense.letter_embedding)


def dense_list(t: Tables, k: int) -> DataFrame:
    q = with_letters(t.scoped_passages()).select("query_id", "lang", "embedding")
    v = durable(with_letters(t.children()).select("child_id", "lang", "embedding"))
    return dense.nearest(q, v, k, metric="dot", part=["lang"])


@query("dense_children", f"WITH {CHILDREN_SQL}, {DENSE_SQL} SELECT query_id, lang, child_id, round(score, 6) AS score, rank FROM d_all WHERE rank <= 10")
def dense_children(t: Tables) -> DataFrame:
    return rounded(dense_list(t, 10), "query_id", "lang")


@query("adaptive_k", f"""WITH {CHILDREN_SQL} SELECT lang, scope_id, count(*) AS children,
  least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE)))::INTEGER AS k,
  least(count(*), 3 * least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE))))::INTEGER AS fetch_k,
  ceil(least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE))) * 0.5::DOUBLE)::INTEGER AS rrf_k, 8 AS final_k
FROM children GROUP BY lang, scope_id""")
def adaptive_k(t: Tables) -> DataFrame:
    return ranking.adaptive_k(t.children().select("lang", "scope_id"), ["lang", "scope_id"])


@query("k_override", f"""WITH {CHILDREN_SQL}, d AS (SELECT lang, least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE)))::INTEGER AS k FROM children GROUP BY lang)
SELECT item_id AS query_id, lang, CASE WHEN length(text) < 200 THEN 5 ELSE k END AS k FROM benchmark, d""")
def k_override(t: Tables) -> DataFrame:
    q = t.scoped_passages().withColumn("k_override", F.when(F.length("text") < 200, 5))
    return ranking.with_overrides(q, ranking.adaptive_k(t.children().select("lang"), ["lang"]), "lang").select("query_id", "lang", "k")


# --- fusion to context ---------------------------------------------------------------------------------------

DEPTHS_SQL = """depths AS (SELECT lang, least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE)))::INTEGER AS k,
  ceil(least(50, greatest(10, ceil(count(*) * 0.1::DOUBLE))) * 0.5::DOUBLE)::INTEGER AS rrf_k FROM children GROUP BY lang)"""
FUSED_SQL = f"""{INDEX_SQL}{bm25_sql('b', 50, True)}, {DENSE_SQL}, {DEPTHS_SQL},
lists AS (SELECT query_id, lang, child_id, rank, 0 AS no FROM b JOIN depths USING (lang) WHERE rank <= k
  UNION ALL SELECT query_id, lang, child_id, rank, 1 FROM d_all JOIN depths USING (lang) WHERE rank <= k),
fused AS (SELECT query_id, lang, child_id, score, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, no, first_rank, child_id)::INTEGER AS rank
  FROM (SELECT query_id, lang, child_id, round(sum(0.5::DOUBLE / (rank + 60)), 9) AS score, min(no) AS no, min_by(rank, no) AS first_rank FROM lists GROUP BY ALL))"""
PARENT_LIST_SQL = FUSED_SQL + """,
firsts AS (SELECT query_id, f.lang, parent_id, min(rank) AS first_rank FROM fused f JOIN depths d ON d.lang = f.lang JOIN children c USING (child_id)
  WHERE rank <= rrf_k GROUP BY ALL),
parent_list AS (SELECT query_id, lang, parent_id, row_number() OVER (PARTITION BY query_id, lang ORDER BY first_rank, parent_id)::INTEGER AS rank FROM firsts)"""
OVERLAP_SQL = f"""round(len(list_intersect(list_distinct({terms_sql('q.text')}), {terms_sql('p.text')})) / greatest(len(list_distinct({terms_sql('q.text')})), 1), 6)"""
FINAL_SQL = PARENT_LIST_SQL + f""",
gated AS (SELECT *, count(*) OVER (PARTITION BY query_id, lang) AS n FROM parent_list),
rescored AS (SELECT g.query_id, g.lang, g.parent_id, g.rank AS old, {OVERLAP_SQL} AS score
  FROM gated g JOIN benchmark q ON q.item_id = g.query_id JOIN parents p ON p.parent_id = g.parent_id WHERE n > 8 AND rank <= 20),
final AS (SELECT query_id, lang, parent_id, rank, NULL::DOUBLE AS score, false AS reranked FROM gated WHERE n <= 8
  UNION ALL SELECT query_id, lang, parent_id, rank, score, true FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, old)::INTEGER AS rank FROM rescored) WHERE rank <= 7)"""
KEYS = ["query_id", "lang"]


def fused_list(t: Tables) -> DataFrame:
    depths = ranking.adaptive_k(t.children().select("lang"), ["lang"])
    found = sparse.bm25(t.scoped_passages(), child_index(t), 50, match={"lang": "lang"})
    lists = [(ranking.cut(found, depths, ["lang"], "k"), 0.5), (ranking.cut(dense_list(t, 50), depths, ["lang"], "k"), 0.5)]
    return ranking.fuse(lists, KEYS, upper=100)  # two lists of at most 50


def parent_list(t: Tables) -> DataFrame:
    depths = ranking.adaptive_k(t.children().select("lang"), ["lang"])
    kept = ranking.cut(fused_list(t), depths, ["lang"], "rrf_k")
    return ranking.backtrack(kept, t.children().select("child_id", "parent_id"), KEYS, upper=100)


def final_list(t: Tables) -> DataFrame:
    return ranking.rerank(durable(parent_list(t)), t.scoped_passages(), t.parents(), KEYS)


@query("rrf_fusion", f"WITH {FUSED_SQL} SELECT query_id, lang, child_id, round(score, 6) AS score, rank FROM fused")
def rrf_fusion(t: Tables) -> DataFrame:
    return rounded(fused_list(t), *KEYS)


@query("parent_backtrack", f"WITH {PARENT_LIST_SQL} SELECT query_id, lang, parent_id, rank FROM parent_list")
def parent_backtrack(t: Tables) -> DataFrame:
    return parent_list(t)


@query("hybrid_search", f"WITH {FINAL_SQL} SELECT query_id, lang, parent_id, rank, score, reranked FROM final")
def hybrid_search(t: Tables) -> DataFrame:
    return final_list(t)


@query("rerank_gate", f"""WITH {PARENT_LIST_SQL}
SELECT query_id, lang, count(*) AS parents, count(*) > 8 AS rescored, least(count(*), 20) AS candidates FROM parent_list GROUP BY query_id, lang""")
def rerank_gate(t: Tables) -> DataFrame:
    n = F.count("*")
    return parent_list(t).groupBy(*KEYS).agg(
        n.alias("parents"), (n > ranking.FINAL_K).alias("rescored"), F.least(n, F.lit(ranking.MAX_CANDIDATES)).alias("candidates")
    )


@query("context_assembly", f"""WITH {FINAL_SQL}
SELECT query_id, lang, coalesce(string_agg('Metadata: {{file_id=' || p.file_id || ', parent_index=' || p.parent_index || '}}' || chr(10) || 'Content: ' || p.text,
  chr(10) || chr(10) ORDER BY f.rank), '未检索到相关文档。') AS context
FROM (SELECT item_id AS query_id, unnest((SELECT list(DISTINCT lang) FROM documents WHERE lang IS NOT NULL)) AS lang FROM benchmark) LEFT JOIN final f USING (query_id, lang) LEFT JOIN parents p ON p.parent_id = f.parent_id GROUP BY query_id, lang""")
def context_assembly(t: Tables) -> DataFrame:
    rows = few(final_list(t)).join(t.parents().select("parent_id", "file_id", "parent_index", "text"), "parent_id")
    metadata = ranking.visible(
        F.create_map(F.lit("file_id"), F.col("file_id").cast("string"), F.lit("parent_index"), F.col("parent_index").cast("string"))
    )
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat_ws("=", e["key"], e["value"])), ", "), F.lit("}"))
    blocks = rows.select(*KEYS, "rank", ranking.context_block(shown, F.col("text")).alias("block"))
    return ranking.with_empty_context(t.scoped_passages(), ranking.assemble(blocks, KEYS), KEYS)


@query("flat_search_preset", f"""WITH flat AS (SELECT doc_id AS file_id, doc_id::VARCHAR || ':' || i AS child_id, substr(text, i * 412 + 1, 512) AS text
  FROM (SELECT *, unnest(range(0, (greatest(length(text) - 100, 1) - 1) // 412 + 1)) AS i FROM documents)),
toks AS (SELECT * FROM (SELECT child_id, 'all' AS lang, {terms_sql('text')} AS tokens FROM flat) WHERE len(tokens) > 0),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM toks),
postings AS (SELECT term, child_id, lang, count(*) AS tf, any_value(dl) AS dl FROM (SELECT child_id, lang, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY ALL),
term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term){bm25_sql('b', 30, False, 'tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))', OKAPI_IDF)},
emb AS (SELECT child_id, {LETTERS_SQL}::DOUBLE[26] AS vec FROM flat), qemb AS (SELECT item_id AS query_id, {LETTERS_SQL}::DOUBLE[26] AS vec FROM benchmark),
d AS (SELECT query_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM (
  SELECT query_id, child_id, round(array_cosine_similarity(q.vec, e.vec), 9) AS score FROM qemb q, emb e WHERE list_sum(e.vec::DOUBLE[]) > 0)),
lists AS (SELECT query_id, child_id, rank, 0 AS no FROM b UNION ALL SELECT query_id, child_id, rank, 1 FROM d WHERE rank <= 30)
SELECT query_id, child_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, no, first_rank, child_id)::INTEGER AS rank
  FROM (SELECT query_id, child_id, round(sum(0.5::DOUBLE / (rank + 60)), 9) AS score, min(no) AS no, min_by(rank, no) AS first_rank FROM lists GROUP BY ALL)) WHERE rank <= 7""")
def flat_search_preset(t: Tables) -> DataFrame:
    from corpusloom.operators.chunking import window_chunks

    flat = window_chunks(t.files().select("file_id", "text"), "text", 512, 100, "i")
    flat = flat.withColumn("child_id", F.concat_ws(":", "file_id", "i"))
    found = sparse.bm25(t.passages(), sparse.build_index(flat, variant="okapi"), 30, variant="okapi")
    near = dense.nearest(with_letters(t.passages()), durable(with_letters(flat).select("child_id", "embedding")), 30, metric="dot")
    fused = ranking.fuse([(found, 0.5), (near, 0.5)], ["query_id"])
    return ranking.first_n(fused, 7).select("query_id", "child_id", "score", "rank")


@query("passage_search_quality", f"""WITH {INDEX_SQL}{bm25_sql('b', 50, False)},
firsts AS (SELECT query_id, file_id, min(rank) AS first_rank FROM b JOIN children USING (child_id) GROUP BY ALL),
docs AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, file_id) AS rank FROM firsts),
truth AS (SELECT item_id AS query_id, doc_id AS file_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
refs AS (SELECT query_id, count(*) AS refs FROM truth GROUP BY 1),
hits AS (SELECT query_id, rank FROM docs JOIN truth USING (query_id, file_id) WHERE rank <= 8)
SELECT item_id AS query_id, coalesce(refs, 0) AS refs,
  CASE WHEN refs IS NULL THEN NULL ELSE round(coalesce((SELECT count(*) FROM hits h WHERE h.query_id = item_id) / least(8, (SELECT count(*) FROM docs d WHERE d.query_id = item_id)), 0), 6) END AS precision_at_8,
  CASE WHEN refs IS NULL THEN NULL ELSE round((SELECT count(*) FROM hits h WHERE h.query_id = item_id) / refs, 6) END AS recall_at_8,
  CASE WHEN refs IS NULL THEN NULL ELSE round(coalesce((SELECT 1 / min(rank) FROM hits h WHERE h.query_id = item_id), 0), 6) END AS mrr_at_8
FROM benchmark LEFT JOIN refs ON refs.query_id = item_id""")
def passage_search_quality(t: Tables) -> DataFrame:
    """Which documents answer each passage best, and how good is the ranking?"""
    found = sparse.bm25(t.passages(), child_index(t), 50)
    docs = ranking.backtrack(found, t.children().select("child_id", "file_id"), ["query_id"], parent="file_id")
    got = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_id"))).alias("got"))
    refs = containing_documents(t).groupBy("query_id").agg(F.collect_set("file_id").alias("truth"))
    rows = t.passages().select("query_id").join(got, "query_id", "left").join(refs, "query_id", "left")
    ids = F.transform(F.coalesce("got", F.array()), lambda s: s["file_id"])
    return rows.select(
        "query_id",
        F.size(F.coalesce("truth", F.array())).cast("long").alias("refs"),
        F.round(M.precision_at(ids, F.col("truth"), 8), 6).alias("precision_at_8"),
        F.round(M.recall_at(ids, F.col("truth"), 8), 6).alias("recall_at_8"),
        F.round(M.mrr_at(ids, F.col("truth"), 8), 6).alias("mrr_at_8"),
    )


def containing_documents(t: Tables) -> DataFrame:
    """(query_id, file_id) of documents that hold a passage word for word.

    A passage's rarest whole word is looked up first; only documents with that word are compared. The edges of a passage may
    cut its first and last word: where it has no other, documents are compared that have a word with the longer of them
    inside. A passage without any word is compared with every document.
    """
    asked = durable(t.passages().dropna().distinct().withColumn("words", folded_words(F.col("text"))))
    held = t.files().select("file_id", F.explode(F.array_distinct(folded_words(F.col("text")))).alias("word"))
    inner = asked.select("query_id", "text", F.explode(F.array_distinct(whole_words(F.col("words")))).alias("word"))
    first, last = F.get("words", F.lit(0)), F.element_at("words", -1)
    piece = F.when(F.length(first) < F.length(last), last).otherwise(first)
    short = durable(asked.where(F.size("words").between(1, 2)).select("query_id", "text", piece.alias("piece")))
    around = short.select("piece", F.col("piece").alias("word")).limit(0)
    if not short.isEmpty():
        around = durable(words_around(held.select("word").distinct(), short.select("piece").distinct()))
    wanted = durable(inner.select("word").union(around.select("word")).distinct())
    doc_words = held.join(wanted, "word", "left_semi")
    sizes = doc_words.groupBy("word").agg(F.count("*").alias("df"))
    rare = inner.join(sizes, "word").groupBy("query_id", "text").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    looked_up = rare.unionByName(short.join(around, "piece").drop("piece"))
    pairs = looked_up.join(doc_words, "word").select("query_id", "file_id", "text").distinct()
    bodies = t.files().select("file_id", F.col("text").alias("body"))
    holds = F.col("body").contains(F.col("text"))
    found = pairs.join(bodies, "file_id").where(holds).select("query_id", "file_id")
    bare = asked.where(F.size("words") == 0).select("query_id", "text")
    return found if bare.isEmpty() else found.unionByName(bodies.join(bare, holds).select("query_id", "file_id"))


def folded_words(text: Column) -> Column:
    """Words to look up. What follows a sigma decides its lower case, and the edge of a passage hides that: one form for all."""
    return words(F.replace(F.replace(text, F.lit("Σ"), F.lit("σ")), F.lit("ς"), F.lit("σ")))


def whole_words(found: Column) -> Column:
    """Words that cannot be cut by the passage's edges: all but the first and the last."""
    return F.slice(found, 2, F.greatest(F.size(found) - 2, F.lit(0)))


def words_around(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """(piece, word) for the distinct words that have a distinct piece inside.

    Both meet by the first three characters of a piece, so that not every piece is compared with every word.
    """
    starts = F.regexp_extract_all("word", F.lit("(?=(.{1,3}))"), 1)  # of what begins at each place of the word
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, F.substring(s, 1, 2), F.substring(s, 1, 1)))))
    keyed = pieces.withColumn("gram", F.substring("piece", 1, 3))
    met = vocabulary.select("word", F.explode(grams).alias("gram")).join(keyed, "gram")
    return met.where(F.col("word").contains(F.col("piece"))).select("piece", "word")
