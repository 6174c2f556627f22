"""Registered queries: metadata filters, scopes, slots, set differences, newest-first lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import querytype as Q
from corpusloom.functions.text import sentences
from corpusloom.operators import filters, scoring
from corpusloom.plans.datasets import SAMPLES_SQL, normal
from corpusloom.plans.dialogues import PAIRS_SQL, pairs
from corpusloom.plans.planning import PLAN_SQL, picked
from corpusloom.plans.registry import CHILDREN_SQL, PARENTS_SQL, Tables, query


@query("metadata_filter", """SELECT doc_id, source, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500 AND n_chars <= 5000 AND source IS NOT NULL""")
def metadata_filter(t: Tables) -> DataFrame:
    wanted = {"lang": ["en", "de"], "n_chars": {"gt": 500, "lte": 5000}, "source": {"exists": True}, "k": 8}
    return t.spark.read.parquet(f"{t.folder}/documents.parquet").where(filters.metadata_filter(wanted)).select("doc_id", "source", "lang", "n_chars")


@query("scope_filter", f"WITH {CHILDREN_SQL} SELECT child_id, file_id FROM children WHERE scope_id = 'src3'")
def scope_filter(t: Tables) -> DataFrame:
    scopes = t.files().select("scope_id", "file_id")
    return filters.in_scope(t.children().select("child_id", "file_id"), scopes, "src3").select("child_id", "file_id")


@query("scope_change", """SELECT source AS scope_id, doc_id AS file_id FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'src2', doc_id FROM labels WHERE quality = 1""")
def scope_change(t: Tables) -> DataFrame:
    """Scope src1 is cleared, scope src2 now holds the approved files."""
    scopes = t.documents.select(F.col("source").alias("scope_id"), F.col("doc_id").alias("file_id"))
    approved = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("file_id"))
    return filters.set_scope(filters.clear_scope(scopes, "src1"), "src2", approved)


@query("query_rejects", """WITH q AS (SELECT event_id AS query_id, CASE WHEN value < 2 THEN ' ' ELSE event_type END AS text, 'src' || (user_id // 2) AS scope_id FROM events),
s AS (SELECT DISTINCT source AS scope_id FROM documents)
SELECT query_id, CASE WHEN trim(text) = '' THEN 'empty_query' ELSE 'empty_scope' END AS reject_reason FROM q WHERE trim(text) = '' OR scope_id NOT IN (FROM s)""")
def query_rejects(t: Tables) -> DataFrame:
    q = t.events.select(
        F.col("event_id").alias("query_id"), F.when(F.col("value") < 2, " ").otherwise(F.col("event_type")).alias("text"),
        F.concat(F.lit("src"), F.floor(F.col("user_id") / 2).cast("string")).alias("scope_id"),
    )
    checked = filters.check_queries(q, t.documents.select(F.col("source").alias("scope_id")))
    return checked.where(F.col("reject_reason").isNotNull()).select("query_id", "reject_reason")


@query("scalar_metadata", """SELECT event_id, props->>'k' AS k, user_id::VARCHAR AS user_id, NULL::VARCHAR AS raw FROM events""")
def scalar_metadata(t: Tables) -> DataFrame:
    """The raw JSON object is nested and drops out."""
    metadata = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("raw"), F.col("props")
    )
    flat = filters.scalar_metadata(metadata)
    return t.events.select("event_id", *[F.element_at(flat, F.lit(n)).alias(n) for n in ("k", "user_id", "raw")])


@query("files_newest_first", "SELECT doc_id AS file_id, ts FROM documents LEFT JOIN events ON event_id = doc_id ORDER BY ts DESC NULLS LAST, doc_id")
def files_newest_first(t: Tables) -> DataFrame:
    dates = t.events.select(F.col("event_id").alias("file_id"), F.col("ts"))
    return t.files().select("file_id").join(dates, "file_id", "left").orderBy(F.desc_nulls_last("ts"), "file_id")


@query("unused_parents", f"WITH {PLAN_SQL} SELECT parent_id FROM parents WHERE parent_id NOT IN (SELECT parent_id FROM picked)")
def unused_parents(t: Tables) -> DataFrame:
    return t.parents().select("parent_id").join(picked(t).select("parent_id"), "parent_id", "left_anti")


@query("missing_types", f"""WITH {SAMPLES_SQL}, h AS (SELECT difficulty_level, list_distinct(list(query_type)) AS have FROM samples GROUP BY 1)
SELECT difficulty_level, array_to_string(list_filter(['single_hop_specific','single_hop_abstract','multi_hop_specific','multi_hop_abstract'], lambda x: NOT list_contains(have, x)), '|') AS missing FROM h""")
def missing_types(t: Tables) -> DataFrame:
    known = F.array(*[F.lit(q) for q in Q.QUERY_TYPES])
    have = normal(t).groupBy("difficulty_level").agg(F.collect_set("query_type").alias("have"))
    return have.select("difficulty_level", F.array_join(F.array_except(known, F.col("have")), "|").alias("missing"))


@query("generated_rows", f"""WITH {PARENTS_SQL}, s AS (SELECT parent_id, unnest(list_filter(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s) <> '')) AS q, length(text) AS n FROM parents),
x AS (SELECT parent_id, q, row_number() OVER (PARTITION BY parent_id ORDER BY q) AS generated_no, n FROM s)
SELECT parent_id, generated_no::INTEGER AS generated_no, q AS user_input, 'single_hop_specific' AS query_type, 'template' AS query_type_source FROM x WHERE generated_no <= n // 200""")
def generated_rows(t: Tables) -> DataFrame:
    """Template generator: the sentences of each chunk; long chunks are asked for more."""
    rows = t.parents().select("parent_id", F.explode(sentences(F.col("text"))).alias("user_input"), F.floor(F.length("text") / 200).alias("requested"))
    out = filters.stamped(rows, ["parent_id"], "user_input", "requested", F.lit("single_hop_specific"), "template")
    return out.select("parent_id", "generated_no", "user_input", "query_type", "query_type_source")


@query("reference_answers", f"""WITH {PAIRS_SQL} SELECT conv_id, ai_turn, CASE WHEN length(answer) >= 400 THEN 'ai' ELSE 'history' END AS reference_answer_source,
  CASE WHEN length(answer) >= 400 THEN trim(list_filter(regexp_split_to_array(reference_contexts[1], '[.!?\\n]+'), lambda s: trim(s) <> '')[1]) ELSE answer END AS reference_answer FROM pairs WHERE len(reference_contexts) > 0""")
def reference_answers(t: Tables) -> DataFrame:
    """Stand-in generator: the first context's leading sentence, for long answers only."""
    rows = pairs(t).where(F.size("reference_contexts") > 0).withColumn("reference_answer", F.col("answer"))
    lead = F.get(sentences(F.get("reference_contexts", F.lit(0))), F.lit(0))
    fresh = F.when(F.length("answer") >= 400, lead).otherwise("")
    return filters.reference_answers(rows, fresh).select("conv_id", "ai_turn", "reference_answer_source", "reference_answer")


@query("online_records", f"""WITH {PAIRS_SQL} SELECT conv_id, ai_turn, 'online_heuristic' AS query_type_source, len(parent_doc_ids)::INTEGER AS retrieved_doc_count, len(scope_file_ids)::INTEGER AS retrieved_file_count,
  len(reference_contexts)::INTEGER AS retrieved_context_count, CASE WHEN len(list_distinct(parent_doc_ids)) >= 2 OR len(scope_file_ids) >= 2 OR regexp_matches(lower(user_input), '\\bbetween\\b|\\brelationship\\b|\\bimpact\\b|\\bdepend\\b|\\balso\\b') THEN 'multi' ELSE 'single' END AS hop_count FROM pairs""")
def online_records(t: Tables) -> DataFrame:
    rows = pairs(t).withColumnsRenamed({"parent_doc_ids": "actual_doc_ids", "scope_file_ids": "actual_file_ids", "reference_contexts": "actual_contexts"})
    out = filters.online_record(rows, Q.detect(F.col("user_input"), F.col("actual_doc_ids"), F.col("actual_file_ids")))
    return out.select("conv_id", "ai_turn", "query_type_source", "retrieved_doc_count", "retrieved_file_count", "retrieved_context_count", "hop_count")


@query("judge_input", f"""WITH {SAMPLES_SQL} SELECT sample_id, user_input, reference_answer AS response, CASE WHEN difficulty_level = 'hard' THEN reference_answer END AS reference,
  CASE WHEN len(reference_contexts) > 0 THEN len(reference_contexts) END AS reference_contexts, len(reference_doc_ids) AS retrieved_context_ids FROM samples""")
def judge_input(t: Tables) -> DataFrame:
    hard = F.col("difficulty_level") == "hard"
    records = normal(t).select(
        "sample_id", "user_input", F.col("reference_answer").alias("actual_response"), F.col("reference_contexts").alias("actual_contexts"),
        F.when(hard, F.col("reference_answer")).otherwise("").alias("reference_answer"), "reference_contexts",
        F.col("reference_doc_ids").alias("reference_context_ids"), F.col("reference_doc_ids").alias("actual_doc_ids"),
    )
    cols = scoring.judge_input(records.columns)
    n = lambda c: F.when(cols[c].isNotNull(), F.size(cols[c])).cast("long")
    return records.select(
        "sample_id", cols["user_input"].alias("user_input"), cols["response"].alias("response"), cols["reference"].alias("reference"),
        n("reference_contexts").alias("reference_contexts"), n("retrieved_context_ids").alias("retrieved_context_ids"),
    )
