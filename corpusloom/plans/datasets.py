"""Registered queries over evaluation samples, which are the answered questions of the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import querytype as Q
from corpusloom.functions.text import sentences
from corpusloom.operators import registry_ops, samples as S
from corpusloom.plans.dialogues import PAIRS_SQL, pairs
from corpusloom.plans.registry import PARENTS_SQL, Tables, query

SAMPLES_SQL = PAIRS_SQL + """,
typed AS (SELECT *, lower(trim(user_input)) AS q, len(list_distinct(parent_doc_ids)) >= 2 OR len(scope_file_ids) >= 2 AS evidence FROM pairs),
samples AS (SELECT 's' || conv_id || '-' || ai_turn AS sample_id, conv_id, ai_turn, user_input, answer AS reference_answer, reference_contexts,
  [x FOR x IN [parent_doc_ids[1], parent_doc_ids[2], parent_doc_ids[3]] IF x IS NOT NULL] AS raw_ids,
  list_filter([parent_doc_ids[1], CASE WHEN parent_doc_ids[2] <> parent_doc_ids[1] THEN parent_doc_ids[2] END, CASE WHEN parent_doc_ids[3] <> parent_doc_ids[1] AND parent_doc_ids[3] <> parent_doc_ids[2] THEN parent_doc_ids[3] END], lambda x: x IS NOT NULL) AS reference_doc_ids,
  scope_file_ids, CASE WHEN length(answer) >= 700 THEN 'hard' WHEN length(answer) >= 400 THEN 'medium' ELSE 'easy' END AS difficulty_level,
  'general' AS scenario_type, 'replay' AS source_type,
  (CASE WHEN evidence OR regexp_matches(q, '\\bbetween\\b|\\brelationship\\b|\\bimpact\\b|\\bdepend\\b|\\balso\\b') THEN 'multi' ELSE 'single' END) || '_hop_' ||
  (CASE WHEN regexp_matches(q, '\\bwhy\\b|\\bhow\\b|\\bcompare\\b|\\bdifference\\b|\\bsummar|\\boverview\\b|\\bexplain\\b') THEN 'abstract' ELSE 'specific' END) AS query_type,
  CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status, '' AS review_notes,
  CASE WHEN length(answer) >= 400 THEN scope_file_ids ELSE [] END AS reference_file_ids,
  CASE WHEN length(answer) < 400 AND len(scope_file_ids) = 1 THEN scope_file_ids[1] ELSE '' END AS source_file_id
  FROM typed LEFT JOIN labels ON doc_id = conv_id)"""


def samples(t: Tables) -> DataFrame:
    found = Q.detect(F.col("user_input"), F.col("parent_doc_ids"), F.col("scope_file_ids"))
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    short = F.length("answer") < 400
    none = F.array().cast("array<string>")
    judged = pairs(t).join(t.labels.select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")
    unknown = F.lit("unknown")
    return judged.select(
        F.concat(F.lit("s"), F.concat_ws("-", "conv_id", "ai_turn")).alias("sample_id"), "conv_id", "ai_turn", "user_input",
        F.col("answer").alias("reference_answer"), "reference_contexts", F.col("parent_doc_ids").alias("reference_doc_ids"), "scope_file_ids",
        F.when(F.length("answer") >= 700, "hard").when(F.length("answer") >= 400, "medium").otherwise("easy").alias("difficulty_level"),
        F.lit("general").alias("scenario_type"), F.lit("replay").alias("source_type"), found["query_type"].alias("query_type"),
        unknown.alias("hop_count"), unknown.alias("abstraction_level"), unknown.alias("evidence_topology"), F.lit("heuristic").alias("query_type_source"),
        F.array(F.lit("regression"), F.lit("replay")).alias("tags"), status.alias("review_status"), F.lit("").alias("review_notes"),
        none.alias("capabilities"), F.when(short, none).otherwise(F.col("scope_file_ids")).alias("reference_file_ids"),
        F.when(short & (F.size("scope_file_ids") == 1), F.get("scope_file_ids", F.lit(0))).otherwise("").alias("source_file_id"),
    )


def normal(t: Tables) -> DataFrame:
    return S.normalize(samples(t))


@query("sample_rows", f"""WITH {SAMPLES_SQL} SELECT sample_id, user_input, reference_answer, array_to_string(reference_doc_ids, '|') AS reference_doc_ids, array_to_string(scope_file_ids, '|') AS scope_file_ids,
  difficulty_level, query_type, split_part(query_type, '_', 1) AS hop_count, split_part(query_type, '_', 3) AS abstraction_level, review_status,
  array_to_string(list_filter(['has_reference_answer', CASE WHEN len(reference_contexts) > 0 THEN 'has_reference_contexts' END, 'has_reference_doc_ids'], lambda x: x IS NOT NULL), '|') AS capabilities FROM samples""")
def sample_rows(t: Tables) -> DataFrame:
    return normal(t).select(
        "sample_id", "user_input", "reference_answer", F.array_join("reference_doc_ids", "|").alias("reference_doc_ids"), F.array_join("scope_file_ids", "|").alias("scope_file_ids"),
        "difficulty_level", "query_type", "hop_count", "abstraction_level", "review_status", F.array_join("capabilities", "|").alias("capabilities"),
    )


@query("shared_capabilities", f"""WITH {SAMPLES_SQL}, c AS (SELECT unnest(list_filter(['has_reference_answer', CASE WHEN len(reference_contexts) > 0 THEN 'has_reference_contexts' END, 'has_reference_doc_ids', CASE WHEN difficulty_level = 'hard' THEN 'has_rubric' END], lambda x: x IS NOT NULL)) AS capability FROM samples)
SELECT capability, count(*) = (SELECT count(*) FROM samples) AS shared FROM c GROUP BY 1""")
def shared_capabilities(t: Tables) -> DataFrame:
    with_rubric = normal(t).withColumn("capabilities", F.when(F.col("difficulty_level") == "hard", F.array_append("capabilities", F.lit("has_rubric"))).otherwise(F.col("capabilities")))
    shared = S.shared_capabilities(with_rubric).withColumn("_s", F.lit(True))
    return S.any_capabilities(with_rubric).join(shared, "capability", "left").select("capability", F.coalesce("_s", F.lit(False)).alias("shared"))


@query("dataset_report", f"""WITH {SAMPLES_SQL} SELECT 'review_status' AS dimension, review_status AS value, count(*) AS n FROM samples GROUP BY ALL
UNION ALL SELECT 'source_type', source_type, count(*) FROM samples GROUP BY ALL UNION ALL SELECT 'scenario_type', scenario_type, count(*) FROM samples GROUP BY ALL
UNION ALL SELECT 'difficulty_level', difficulty_level, count(*) FROM samples GROUP BY ALL""")
def dataset_report(t: Tables) -> DataFrame:
    return S.dimension_counts(normal(t))


@query("dataset_ratios", f"""WITH {SAMPLES_SQL}, x AS (SELECT count(*) AS n, count(*) AS a, count(*) FILTER (len(reference_contexts) > 0) AS c, count(*) FILTER (len(reference_doc_ids) > 0) AS d, count(*) FILTER (len(scope_file_ids) > 0) AS s FROM samples)
SELECT n AS sample_count, a AS with_reference_answer, c AS with_reference_contexts, d AS with_reference_doc_ids, s AS with_scope_file_ids,
  round(a / n, 6) AS with_reference_answer_ratio, round(c / n, 6) AS with_reference_contexts_ratio, round(d / n, 6) AS with_reference_doc_ids_ratio, round(s / n, 6) AS with_scope_file_ids_ratio,
  (SELECT count(DISTINCT f) FROM (SELECT unnest(scope_file_ids) AS f FROM samples)) AS unique_scope_files, (SELECT count(DISTINCT f) FROM (SELECT unnest(reference_doc_ids) AS f FROM samples)) AS unique_reference_docs FROM x""")
def dataset_ratios(t: Tables) -> DataFrame:
    rows = normal(t)
    return S.coverage_flags(rows).select(
        "*", S.unique_ids(rows, "scope_file_ids").scalar().alias("unique_scope_files"), S.unique_ids(rows, "reference_doc_ids").scalar().alias("unique_reference_docs")
    )


@query("file_coverage", f"""WITH {SAMPLES_SQL}, x AS (SELECT unnest(CASE WHEN len(reference_file_ids) > 0 THEN reference_file_ids WHEN source_file_id <> '' THEN [source_file_id] WHEN len(scope_file_ids) = 1 THEN scope_file_ids ELSE [] END) AS file_id FROM samples)
SELECT file_id, count(*) AS samples FROM x GROUP BY 1 ORDER BY samples DESC, file_id LIMIT 10""")
def file_coverage(t: Tables) -> DataFrame:
    return S.file_coverage(normal(t))


VALID_SQL = SAMPLES_SQL + """,
v AS (SELECT sample_id, query_type, CASE WHEN starts_with(query_type, 'multi') THEN least(len(reference_doc_ids), 2) ELSE 0 END AS hops, len(reference_doc_ids) AS docs, len(reference_file_ids) AS files,
  regexp_matches(lower(user_input), 'why|how|explain|compare|difference|summar|overview') AS cue FROM samples),
w AS (SELECT *, greatest(hops, docs, files) AS ev FROM v),
issues AS (SELECT sample_id, query_type, hops, docs, files, ev, list_filter([
    CASE WHEN starts_with(query_type, 'multi') AND ev < 2 THEN 'error:insufficient_multihop_evidence' END,
    CASE WHEN starts_with(query_type, 'single') AND ev >= 2 THEN 'error:singlehop_conflict_evidence' END,
    CASE WHEN ends_with(query_type, '_abstract') AND NOT cue THEN 'warn:abstract_without_cue' END,
    CASE WHEN ends_with(query_type, '_specific') AND cue THEN 'warn:specific_with_abstract_cue' END], lambda x: x IS NOT NULL) AS issues FROM w)"""


def hopped(t: Tables) -> DataFrame:
    rows = normal(t)
    hops = Q.reasoning_hops(F.col("query_type"), F.col("reference_doc_ids"), F.col("scope_file_ids"))
    return rows.withColumn("reasoning_hops", hops)


@query("type_validate", f"""WITH {VALID_SQL} SELECT sample_id, array_to_string(issues, '|') AS issues, len(list_filter(issues, lambda x: starts_with(x, 'error'))) = 0 AS valid FROM issues""")
def type_validate(t: Tables) -> DataFrame:
    rows = S.validate(hopped(t))
    return rows.select("sample_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["code"])), "|").alias("issues"), "valid")


@query("validation_summary", f"""WITH {VALID_SQL}, x AS (SELECT len(list_filter(issues, lambda x: starts_with(x, 'error'))) AS e, len(list_filter(issues, lambda x: starts_with(x, 'warn'))) AS w FROM issues)
SELECT count(*) AS input_count, count(*) FILTER (e = 0) AS output_count, count(*) FILTER (e > 0) AS dropped_count, sum(e)::BIGINT AS error_count, sum(w)::BIGINT AS warning_count FROM x""")
def validation_summary(t: Tables) -> DataFrame:
    return S.validation_counts(hopped(t), "strict")[0]


@query("validation_codes", f"WITH {VALID_SQL} SELECT split_part(i, ':', 2) AS code, count(*) AS n FROM (SELECT unnest(issues) AS i FROM issues) GROUP BY 1")
def validation_codes(t: Tables) -> DataFrame:
    return S.validation_counts(hopped(t), "warn")[1]


@query("evidence_counts", f"WITH {VALID_SQL} SELECT sample_id, hops::INTEGER AS hop_evidence, docs::INTEGER AS doc_evidence, files::INTEGER AS file_evidence, ev::INTEGER AS effective_evidence FROM issues")
def evidence_counts(t: Tables) -> DataFrame:
    counts = Q.evidence_counts(F.col("reasoning_hops"), F.col("reference_doc_ids"), F.col("reference_file_ids"))
    return hopped(t).select("sample_id", *[c.alias(n) for n, c in counts.items()])


@query("text_or_list", """WITH j AS (SELECT doc_id, doc_id % 5 AS form, source, lang, n_chars FROM documents),
v AS (SELECT doc_id, CASE form WHEN 0 THEN [source] WHEN 1 THEN [lang, ' ' || source, '', lang, n_chars::VARCHAR] WHEN 2 THEN [n_chars::VARCHAR] WHEN 3 THEN ['keys', 'only'] ELSE [] END AS vs FROM j),
t AS (SELECT doc_id, list_filter(list_transform(vs, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS vs FROM v)
SELECT doc_id, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i), '|') AS file_ids, len(list_distinct(vs)) AS n FROM t""")
def text_or_list(t: Tables) -> DataFrame:
    """One column of JSON in which an id list is a text, a list, a number, an object, or nothing that can be read."""
    d, form = t.documents, F.col("doc_id") % 5
    several = F.array("lang", F.concat(F.lit(" "), "source"), F.lit(""), "lang", F.col("n_chars").cast("string"))
    stated = (
        F.when(form == 0, F.concat(F.lit('"'), "source", F.lit('"'))).when(form == 1, F.to_json(several)).when(form == 2, F.col("n_chars").cast("string"))
        .when(form == 3, F.lit('{"only": 1, "keys": ["x"]}')).otherwise(F.lit("{broken"))
    )
    ids = Q.ordered_unique(Q.text_or_list(stated))
    return d.select("doc_id", F.array_join(ids, "|").alias("file_ids"), F.size(ids).cast("long").alias("n"))


@query("evidence_topology", f"""WITH {SAMPLES_SQL} SELECT sample_id, CASE WHEN len(list_distinct(scope_file_ids)) >= 2 THEN 'multi_file' WHEN len(reference_doc_ids) >= 2 THEN 'multi_doc_same_file' ELSE 'single_doc' END AS evidence_topology FROM samples""")
def evidence_topology(t: Tables) -> DataFrame:
    return normal(t).select("sample_id", Q.topology(F.col("reference_doc_ids"), F.col("scope_file_ids")).alias("evidence_topology"))


@query("reasoning_hops", f"""WITH {SAMPLES_SQL} SELECT sample_id, 'hop_' || i AS hop_id, 'evidence_link' AS hop_intent, reference_doc_ids[i] AS doc_id, scope_file_ids[1] AS file_id
FROM (SELECT *, unnest(range(1, least(len(reference_doc_ids), 2) + 1)) AS i FROM samples WHERE starts_with(query_type, 'multi_hop_'))""")
def reasoning_hops(t: Tables) -> DataFrame:
    rows = hopped(t).select("sample_id", F.explode("reasoning_hops").alias("h"))
    return rows.select("sample_id", "h.hop_id", "h.hop_intent", F.get("h.reference_doc_ids", F.lit(0)).alias("doc_id"), F.get("h.reference_file_ids", F.lit(0)).alias("file_id"))


@query("context_to_ids", f"""WITH {SAMPLES_SQL}, n AS (SELECT parent_id, file_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM parents),
c AS (SELECT sample_id, i, trim(regexp_replace(reference_contexts[i], '\\s+', ' ', 'g')) AS norm FROM (SELECT *, unnest(range(1, len(reference_contexts) + 1)) AS i FROM samples)),
m AS (SELECT c.sample_id, parent_id, n.file_id, min(i) AS pos FROM c JOIN n USING (norm) JOIN samples s ON s.sample_id = c.sample_id AND list_contains(s.scope_file_ids, n.file_id::VARCHAR) GROUP BY ALL),
g AS (SELECT sample_id, string_agg(parent_id, '|' ORDER BY pos, parent_id, file_id) AS ids, (SELECT string_agg(f, '|' ORDER BY p, q) FROM (SELECT file_id::VARCHAR AS f, min(pos) AS p, min_by(parent_id, (pos, parent_id)) AS q FROM m x WHERE x.sample_id = m.sample_id GROUP BY 1)) AS files FROM m GROUP BY sample_id)
SELECT sample_id, coalesce(ids, array_to_string(reference_doc_ids, '|')) AS reference_doc_ids, coalesce(files, '') AS reference_file_ids FROM samples LEFT JOIN g USING (sample_id)""")
def context_to_ids(t: Tables) -> DataFrame:
    rows = normal(t).select("sample_id", "scope_file_ids", F.col("reference_contexts").alias("contexts"), F.col("reference_doc_ids").alias("fallback_ids"))
    mapped = S.map_contexts(rows, t.parents(), "sample_id")
    return mapped.select("sample_id", *[F.array_join(c, "|").alias(c) for c in ("reference_doc_ids", "reference_file_ids")])


REVIEW_SQL = """review AS (SELECT 's' || doc_id || '-1' AS sample_id, CASE quality WHEN 1 THEN 'approved' ELSE '' END AS review_status, CASE toxic WHEN 1 THEN 'toxic' ELSE '' END AS review_notes, ' hard ' AS difficulty_level, '' AS scenario_type FROM labels)"""


@query("review_apply", f"""WITH {SAMPLES_SQL}, {REVIEW_SQL}, x AS (SELECT s.sample_id, coalesce(nullif(trim(r.review_status), ''), s.review_status) AS review_status, coalesce(nullif(trim(r.review_notes), ''), s.review_notes) AS review_notes,
  coalesce(nullif(trim(r.difficulty_level), ''), s.difficulty_level) AS difficulty_level, s.scenario_type FROM samples s LEFT JOIN review r ON r.sample_id = s.sample_id) SELECT * FROM x WHERE review_status <> 'rejected'""")
def review_apply(t: Tables) -> DataFrame:
    review = t.labels.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("-1")).alias("sample_id"), F.when(F.col("quality") == 1, "approved").otherwise("").alias("review_status"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("review_notes"), F.lit(" hard ").alias("difficulty_level"), F.lit("").alias("scenario_type"),
    )
    return S.apply_review(normal(t), review).select("sample_id", "review_status", "review_notes", "difficulty_level", "scenario_type")


@query("review_sheet", f"""WITH {SAMPLES_SQL} SELECT sample_id, review_status, review_notes, difficulty_level, scenario_type, user_input, reference_answer, array_to_string(scope_file_ids, '|') AS scope_file_ids,
  array_to_string(reference_doc_ids, '|') AS reference_doc_ids, 'regression|replay' AS tags FROM samples""")
def review_sheet(t: Tables) -> DataFrame:
    return S.review_sheet(normal(t))


@query("approved_samples", f"WITH {SAMPLES_SQL} SELECT sample_id FROM samples WHERE review_status IN ('approved', 'pending')")
def approved_samples(t: Tables) -> DataFrame:
    return normal(t).where(F.col("review_status").isin("approved", "pending")).select("sample_id")


@query("approved_first", f"WITH {SAMPLES_SQL} SELECT sample_id, review_status FROM samples WHERE review_status IN ('approved', 'pending') ORDER BY sample_id LIMIT 40")
def approved_first(t: Tables) -> DataFrame:
    """The first samples that may be run, in the order of their ids."""
    return S.reviewed(normal(t), [" Approved", "pending", ""], 40).select("sample_id", "review_status")


@query("manifest", f"""WITH {SAMPLES_SQL} SELECT 'replay' AS name, 'v1' AS version, 'regression' AS category, 'replay' AS source_type, true AS review_required, 6 AS instruction_count, count(*) AS sample_count,
  'has_reference_answer' || CASE WHEN min(len(reference_contexts)) > 0 THEN '|has_reference_contexts' ELSE '' END || '|has_reference_doc_ids' AS capabilities FROM samples""")
def manifest(t: Tables) -> DataFrame:
    row = S.manifest(normal(t), name="replay", version="v1", category="regression", source_type="replay")
    return row.select(
        "name", "version", "category", "source_type", "review_required", F.size("review_instructions").alias("instruction_count"), "sample_count", F.array_join("capabilities", "|").alias("capabilities")
    )


@query("realized_distribution", f"""WITH {SAMPLES_SQL}, d AS (SELECT unnest(['single_hop_specific','single_hop_abstract','multi_hop_specific','multi_hop_abstract']) AS query_type)
SELECT d.query_type, count(s.sample_id) AS n, round(count(s.sample_id) / (SELECT count(*) FROM samples), 6) AS share FROM d LEFT JOIN samples s USING (query_type) GROUP BY 1""")
def realized_distribution(t: Tables) -> DataFrame:
    return S.realized_distribution(normal(t))


@query("duplicate_samples", """SELECT md5(text) AS text_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_samples(t: Tables) -> DataFrame:
    """Ids that occur twice, here the content ids of exact document copies."""
    return registry_ops.duplicate_keys(t.documents.select(F.md5("text").alias("text_hash")), "text_hash")


@query("seed_alias", """SELECT 'seed-' || conv_id || '-' || turn AS sample_id, text AS user_input, CASE WHEN role = 'system' THEN 'unknown' WHEN length(text) > 300 THEN 'hard' ELSE 'unknown' END AS difficulty_level,
  CASE WHEN role = 'assistant' THEN 'import|seed' ELSE role END AS tags FROM conversations""")
def seed_alias(t: Tables) -> DataFrame:
    """Seed rows use either of two field names; empty strings count as missing."""
    user = F.col("role") == "user"
    row_id = F.concat(F.lit("seed-"), F.concat_ws("-", "conv_id", "turn"))
    rows = t.conversations.select(
        F.when(user, F.col("text")).otherwise("").alias("user_input"), F.when(~user, F.col("text")).alias("question"),
        F.when(user, "").otherwise(row_id).alias("sample_id"), F.when(user, row_id).alias("id"),
        F.when((F.col("role") != "system") & (F.length("text") > 300), "hard").otherwise("").alias("difficulty_level"),
        F.when(F.col("role") != "assistant", F.array("role")).alias("tags"),
    )
    return rows.select(
        S.first_filled("sample_id", "id").alias("sample_id"), S.first_filled("user_input", "question").alias("user_input"),
        F.coalesce(F.nullif("difficulty_level", F.lit("")), F.lit("unknown")).alias("difficulty_level"),
        F.array_join(F.coalesce("tags", F.array(F.lit("import"), F.lit("seed"))), "|").alias("tags"),
    )


@query("seed_scope", f"""WITH {SAMPLES_SQL}, u AS (SELECT sample_id, ids[i] AS parent_id, i FROM (SELECT sample_id, reference_doc_ids AS ids, unnest(range(1, len(reference_doc_ids) + 1)) AS i FROM samples WHERE difficulty_level <> 'hard')),
f AS (SELECT sample_id, file_id, min(i) AS p FROM u JOIN parents USING (parent_id) GROUP BY ALL), g AS (SELECT sample_id, string_agg(file_id::VARCHAR, '|' ORDER BY p) AS files FROM f GROUP BY 1)
SELECT sample_id, coalesce(files, array_to_string(CASE WHEN difficulty_level = 'hard' THEN scope_file_ids ELSE [] END, '|')) AS scope_file_ids, files IS NOT NULL AS scope_inferred FROM samples LEFT JOIN g USING (sample_id)""")
def seed_scope(t: Tables) -> DataFrame:
    """Samples that come without a scope get the files of their reference documents."""
    none = F.array().cast("array<string>")
    rows = normal(t).withColumn("scope_file_ids", F.when(F.col("difficulty_level") == "hard", F.col("scope_file_ids")).otherwise(none))
    return S.infer_scope(rows, t.parents()).select("sample_id", F.array_join("scope_file_ids", "|").alias("scope_file_ids"), "scope_inferred")


@query("question_adapter", f"""WITH {PARENTS_SQL}, x AS (SELECT parent_id, list_filter(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s) <> '') AS s FROM parents)
SELECT parent_id, 'Explain the core idea behind: ' || rtrim(s[1], ' ') AS user_input, 'single_hop_abstract' AS query_type FROM x WHERE len(s) > 0""")
def question_adapter(t: Tables) -> DataFrame:
    """Template generator: the leading sentence of each chunk becomes a question."""
    lead = F.get(sentences(F.col("text")), F.lit(0))
    rows = t.parents().select("parent_id", lead.alias("lead")).where(F.col("lead").isNotNull())
    return rows.select("parent_id", S.core_idea_question(F.col("lead")).alias("user_input"), F.lit("single_hop_abstract").alias("query_type"))


@query("usable_rows", f"""WITH {PARENTS_SQL}, x AS (SELECT file_id, list_filter(regexp_split_to_array(any_value(text), '\\n'), lambda s: trim(s) <> '') AS c FROM documents JOIN (SELECT doc_id AS file_id FROM documents) ON file_id = doc_id GROUP BY file_id)
SELECT doc_id AS file_id, CASE WHEN lang = 'en' THEN 'q' || doc_id WHEN lang = 'de' THEN 'u' || doc_id ELSE 'x' || doc_id END AS user_input, len(c)::INTEGER AS context_count FROM documents JOIN x ON x.file_id = doc_id WHERE len(c) > 0 AND lang <> 'fr'""")
def usable_rows(t: Tables) -> DataFrame:
    """Generated rows name their question differently; rows without question or context drop out."""
    name = lambda lang, p: F.when(F.col("lang") == lang, F.concat(F.lit(p), F.col("file_id").cast("string"))).otherwise("")
    rows = t.files().select(
        "file_id", name("de", "u").alias("user_input"), name("en", "q").alias("question"), name("es", "x").alias("query"), F.split("text", "\n").alias("contexts")
    )
    return S.usable_rows(rows).select("file_id", "user_input", F.size("contexts").alias("context_count"))


@query("review_rules", """SELECT source, lang, lang IN ('regression', 'baseline', 'specialized', 'synthetic') AS review_required, count(*) AS files FROM (SELECT source, CASE lang WHEN 'en' THEN 'regression' WHEN 'de' THEN 'baseline' ELSE 'exploration' END AS lang FROM documents) GROUP BY ALL""")
def review_rules(t: Tables) -> DataFrame:
    category = F.when(F.col("lang") == "en", "regression").when(F.col("lang") == "de", "baseline").otherwise("exploration")
    rows = t.documents.select("source", category.alias("lang"))
    return rows.groupBy("source", "lang", S.review_required(F.col("lang")).alias("review_required")).agg(F.count("*").alias("files"))
