"""Registered queries: retrieval metrics, judge measures, run summaries.

A run searches every vector's neighbours among all vectors; the reference is its neighbours of the same label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions.querytype import QUERY_TYPES
from corpusloom.operators import dense, scoring as S
from corpusloom.plans.datasets import SAMPLES_SQL, normal
from corpusloom.plans.registry import STOP_SQL, Tables, query, terms_sql

RUN_SQL = """sims AS (SELECT q.vec_id AS sample_id, c.vec_id AS doc_id, q.label = c.label AS same,
    array_cosine_similarity(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64]) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
got AS (SELECT sample_id, list(doc_id ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(sim, 9) DESC, doc_id) AS r FROM sims) WHERE r <= 8 GROUP BY 1),
ref AS (SELECT sample_id, list(doc_id ORDER BY r) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(sim, 9) DESC, doc_id) AS r FROM sims WHERE same AND round(sim, 9) >= 0.25) WHERE r <= 5 GROUP BY 1),
runs AS (SELECT vec_id AS sample_id, ['single_hop_specific','single_hop_abstract','multi_hop_specific','multi_hop_abstract',''][label % 5 + 1] AS query_type, ids, coalesce(refs, []) AS refs,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN 'tool error' END AS error_message,
    CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS latency_ms, CASE WHEN event_type = 'click' THEN '' ELSE 'answer' END AS actual_response
  FROM embeddings JOIN got ON got.sample_id = vec_id LEFT JOIN ref ON ref.sample_id = vec_id LEFT JOIN events ON event_id = vec_id)"""


def runs(t: Tables) -> DataFrame:
    found = dense.nearest(t.vector_queries(), t.vectors(), 8, metric="cosine", skip_self=True)
    refs = dense.nearest(t.vector_queries(), t.vectors(), 5, metric="cosine", part=["file_id"], skip_self=True, min_score=0.25)
    kinds = F.array(*[F.lit(q) for q in (*QUERY_TYPES, "")])
    samples = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.get(kinds, F.col("label") % 5).alias("query_type"))
    names = {"query_id": "sample_id", "child_id": "doc_id"}
    records = S.run_records(samples, found.withColumnsRenamed(names))
    expected = S.run_records(samples.select("sample_id"), refs.withColumnsRenamed(names)).withColumnRenamed("actual_doc_ids", "reference_doc_ids")
    kind = F.col("event_type")
    outcome = t.events.select(
        F.col("event_id").alias("sample_id"), F.when(kind == "error", "failed").otherwise("success").alias("status"), F.when(kind == "error", "tool error").alias("error_message"),
        F.when(kind != "signup", F.col("value")).alias("latency_ms"), F.when(kind == "click", "").otherwise("answer").alias("actual_response"),
    )
    return records.join(expected, "sample_id").join(outcome, "sample_id", "left")


def metric_sql(name: str, k: int) -> str:
    top = f"ids[:{k}]"
    hits = f"len(list_filter({top}, lambda x: list_contains(refs, x)))"
    gain = lambda n: f"list_sum(list_transform(range(1, {n} + 1), lambda i: 1 / log2(i + 1)))"
    body = {
        "precision": f"{hits} / len({top})",
        "recall": f"{hits} / len(list_distinct(refs))",
        "hit": f"({hits} > 0)::INT::DOUBLE",
        "mrr": f"coalesce(1 / list_min(list_filter(list_transform(range(1, len({top}) + 1), lambda i: CASE WHEN list_contains(refs, ids[i]) THEN i END), lambda x: x IS NOT NULL)), 0)",
        "ndcg": f"coalesce(list_sum(list_transform(range(1, len({top}) + 1), lambda i: CASE WHEN list_contains(refs, ids[i]) THEN 1 / log2(i + 1) ELSE 0 END)), 0) / {gain(f'least(len(refs), {k})')}",
    }[name]
    return f"CASE WHEN len(refs) > 0 THEN round({body}, 6) END AS {name}_at_{k}"


NAMES = [f"{n}_at_{k}" for n in M.METRICS for k in M.K_VALUES]
ALL_METRICS_SQL = ", ".join(metric_sql(n, k) for n in M.METRICS for k in M.K_VALUES)
SCORES_SQL = RUN_SQL + f""",
scores AS (SELECT sample_id, query_type, {ALL_METRICS_SQL} FROM runs WHERE status = 'success' AND actual_response <> '')"""
LONG_SQL = SCORES_SQL + f""", long AS (SELECT * FROM scores UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(NAMES)})))"""


def _single(name: str):
    @query(f"{name}_at_k", f"WITH {RUN_SQL} SELECT sample_id, {', '.join(metric_sql(name, k) for k in M.K_VALUES)} FROM runs")
    def build(t: Tables) -> DataFrame:
        cols = M.all_metrics(F.col("actual_doc_ids"), F.col("reference_doc_ids"))
        return runs(t).select("sample_id", *[c.alias(n) for n, c in cols.items() if n.startswith(name + "_")])


for _name in M.METRICS:
    _single(_name)


def scores(t: Tables) -> DataFrame:
    return S.retrieval_scores(S.successful(runs(t))).select("sample_id", "query_type", *NAMES)


@query("retrieval_scores", f"WITH {SCORES_SQL} SELECT * FROM scores")
def retrieval_scores(t: Tables) -> DataFrame:
    return scores(t)


@query("metric_means", f"WITH {LONG_SQL} SELECT metric, round(avg(value), 6) AS metric_mean, count(value) AS scored FROM long GROUP BY metric")
def metric_means(t: Tables) -> DataFrame:
    means = S.metric_means(S.long_scores(scores(t), ["query_type"], NAMES))
    return means.where(F.col("query_type").isNull()).select("metric", "metric_mean", "scored")


@query("by_query_type", f"""WITH {LONG_SQL} SELECT coalesce(nullif(query_type, ''), 'unknown') AS query_type, metric, round(avg(value), 6) AS metric_mean, count(value) AS scored, count(*) AS samples FROM long GROUP BY 1, 2
UNION ALL SELECT NULL, metric, round(avg(value), 6), count(value), count(*) FROM long GROUP BY 2""")
def by_query_type(t: Tables) -> DataFrame:
    return S.metric_means(S.long_scores(scores(t), ["query_type"], NAMES)).select("query_type", "metric", "metric_mean", "scored", "samples")


@query("run_summary", f"""WITH {RUN_SQL} SELECT count(*) AS total_sample_count, count(*) FILTER (status = 'success' AND actual_response <> '') AS scored_sample_count,
  count(*) FILTER (status <> 'success') AS failed_sample_count, round(avg(latency_ms), 6) AS avg_latency_ms FROM runs""")
def run_summary(t: Tables) -> DataFrame:
    return S.run_summary(runs(t))


@query("failed_samples", f"WITH {RUN_SQL} SELECT sample_id, error_message FROM runs WHERE status <> 'success' ORDER BY sample_id LIMIT 20")
def failed_samples(t: Tables) -> DataFrame:
    return S.failed_samples(runs(t), 20)


@query("score_rows", f"""WITH {SCORES_SQL}, v AS (SELECT doc_id AS sample_id, quality = 1 AS passed FROM labels)
SELECT s.sample_id, query_type, recall_at_8, ndcg_at_8, CASE WHEN passed THEN 1.0::DOUBLE WHEN NOT passed THEN 0.0::DOUBLE END AS correctness_pass FROM scores s LEFT JOIN v USING (sample_id)""")
def score_rows(t: Tables) -> DataFrame:
    verdicts = t.labels.select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("correctness_pass"))
    joined = S.join_scores(scores(t), verdicts)
    return joined.select("sample_id", "query_type", "recall_at_8", "ndcg_at_8", "correctness_pass")


@query("correctness_rate", f"""WITH {RUN_SQL} SELECT count(quality) AS judged, round(avg(quality), 6) AS correctness_pass_rate FROM runs LEFT JOIN labels ON doc_id = sample_id WHERE actual_response <> ''""")
def correctness_rate(t: Tables) -> DataFrame:
    verdicts = t.labels.select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("passed"))
    judged = runs(t).where(F.col("actual_response") != "").join(verdicts, "sample_id", "left")
    return S.pass_rate(judged)


@query("metric_selection", f"""WITH {SAMPLES_SQL} SELECT sample_id, 'faithfulness|answer_relevancy|context_precision' || CASE WHEN difficulty_level = 'hard' THEN '|context_recall' ELSE '' END ||
  CASE WHEN difficulty_level = 'hard' OR len(reference_contexts) > 0 THEN '|context_entities_recall' ELSE '' END AS metrics, CASE WHEN difficulty_level = 'hard' THEN '' ELSE 'context_recall' || CASE WHEN len(reference_contexts) > 0 THEN '' ELSE '|context_entities_recall' END END AS skipped FROM samples""")
def metric_selection(t: Tables) -> DataFrame:
    """Only hard samples keep their reference answer here, so both rules are exercised."""
    caps = F.when(F.col("difficulty_level") == "hard", F.col("capabilities")).otherwise(F.array_remove("capabilities", "has_reference_answer"))
    return normal(t).select("sample_id", *[F.array_join(c, "|").alias(n) for n, c in S.select_metrics(caps).items()])


SENTENCES_SQL = "list_filter(regexp_split_to_array({0}, '[.!?\\n]+'), lambda s: trim(s, ' ') <> '')"
JOINED_SQL = "array_to_string(reference_contexts, ' ')"
CLAIM_SQL = f"""list_transform({SENTENCES_SQL.format('reference_answer')}, lambda s: CASE WHEN len({terms_sql('s')}) > 0 THEN
  len(list_intersect(list_distinct({terms_sql('s')}), {terms_sql(JOINED_SQL)})) / len(list_distinct({terms_sql('s')})) >= 0.2 ELSE false END)"""


@query("judge_faithfulness", f"""WITH {SAMPLES_SQL}, x AS (SELECT sample_id, {CLAIM_SQL} AS v FROM samples)
SELECT sample_id, CASE WHEN len(v) > 0 THEN round(len(list_filter(v, lambda x: x)) / len(v), 6) END AS faithfulness FROM x""")
def judge_faithfulness(t: Tables) -> DataFrame:
    share = S.supported_share(F.col("reference_answer"), F.col("reference_contexts"), S.overlap_judge(0.2))
    return normal(t).select("sample_id", F.round(share, 6).alias("faithfulness"))


@query("judge_context_recall", f"""WITH {SAMPLES_SQL}, x AS (SELECT sample_id, {CLAIM_SQL.replace('reference_answer', 'user_input')} AS v FROM samples)
SELECT sample_id, CASE WHEN len(v) > 0 THEN round(len(list_filter(v, lambda x: x)) / len(v), 6) END AS context_recall FROM x""")
def judge_context_recall(t: Tables) -> DataFrame:
    """Claims of the expected text (here the question's own sentences) found in the contexts."""
    share = S.supported_share(F.col("user_input"), F.col("reference_contexts"), S.overlap_judge(0.2))
    return normal(t).select("sample_id", F.round(share, 6).alias("context_recall"))


@query("judge_context_precision", f"""WITH {SAMPLES_SQL}, c AS (SELECT sample_id, i, CASE WHEN len({terms_sql('user_input')}) > 0 THEN len(list_intersect(list_distinct({terms_sql('user_input')}), {terms_sql('reference_contexts[i]')})) / len(list_distinct({terms_sql('user_input')})) >= 0.2 ELSE false END AS v
  FROM (SELECT *, unnest(range(1, len(reference_contexts) + 1)) AS i FROM samples)),
p AS (SELECT *, sum(v::INT) OVER (PARTITION BY sample_id ORDER BY i) / i AS p FROM c)
SELECT s.sample_id, CASE WHEN len(reference_contexts) > 0 THEN round(coalesce((SELECT sum(CASE WHEN v THEN p ELSE 0 END) / nullif(sum(v::INT), 0) FROM p WHERE p.sample_id = s.sample_id), 0), 6) END AS context_precision FROM samples s""")
def judge_context_precision(t: Tables) -> DataFrame:
    return normal(t).select("sample_id", F.round(S.context_precision(F.col("user_input"), F.col("reference_contexts")), 6).alias("context_precision"))


ENTITIES_SQL = "list_distinct(regexp_extract_all({0}, '\\p{{Lu}}\\p{{L}}+'))"


@query("judge_entity_recall", f"""WITH {SAMPLES_SQL}, x AS (SELECT sample_id, {ENTITIES_SQL.format('reference_answer')} AS w, {ENTITIES_SQL.format(JOINED_SQL)} AS f FROM samples)
SELECT sample_id, CASE WHEN len(w) > 0 THEN round(len(list_intersect(w, f)) / len(w), 6) END AS context_entities_recall FROM x""")
def judge_entity_recall(t: Tables) -> DataFrame:
    return normal(t).select("sample_id", F.round(S.entity_recall(F.col("reference_answer"), F.col("reference_contexts")), 6).alias("context_entities_recall"))


def letters_sql(text: str) -> str:
    return "[" + ", ".join(f"(length(lower({text})) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in dense.LETTERS) + "]::DOUBLE[26]"


@query("judge_answer_relevancy", f"""WITH {SAMPLES_SQL}, s AS (SELECT sample_id, user_input, unnest({SENTENCES_SQL.format('reference_answer')}) AS g FROM samples),
x AS (SELECT sample_id, {letters_sql('user_input')} AS q, {letters_sql('g')} AS v FROM s)
SELECT sample_id, round(avg(array_cosine_similarity(q, v)), 6) AS answer_relevancy FROM x WHERE list_sum(v::DOUBLE[]) > 0 GROUP BY 1""")
def judge_answer_relevancy(t: Tables) -> DataFrame:
    """Mean cosine of the question and questions regenerated from the answer (stand-in: its sentences)."""
    from corpusloom.functions.text import sentences

    rows = normal(t).select("sample_id", dense.letter_embedding(F.col("user_input")).alias("q"), F.explode(sentences(F.col("reference_answer"))).alias("g"))
    rows = rows.select("sample_id", "q", dense.letter_embedding(F.col("g")).alias("v")).where(F.col("v").isNotNull())
    cosine = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return rows.groupBy("sample_id").agg(F.round(F.avg(cosine), 6).alias("answer_relevancy"))
