"""Registered queries over the events table, read as a log of evaluated requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import querytype as Q
from corpusloom.operators import online as O
from corpusloom.operators import scoring
from corpusloom.plans.registry import Tables, query
from corpusloom.streaming import jobs

RECORDS_SQL = """records AS (SELECT event_id::VARCHAR AS request_id, user_id::VARCHAR AS conversation_id, ts AS request_created_at, value AS latency_ms, event_type AS query_type FROM events),
summaries AS (SELECT event_id::VARCHAR AS request_id, ts + to_microseconds((value * 1000000)::BIGINT) AS evaluation_created_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  props->>'k' AS k, value::VARCHAR AS seconds, event_type AS note FROM events),
entries AS (SELECT * FROM records JOIN summaries USING (request_id))"""


def records(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("conversation_id"),
        F.col("ts").cast("timestamp").alias("request_created_at"), F.col("value").alias("latency_ms"), F.col("event_type").alias("query_type"),
    )


def summaries(t: Tables) -> DataFrame:
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000000).cast("long"))
    metrics = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("seconds"), F.col("value").cast("string"), F.lit("note"), F.col("event_type")
    )
    return t.events.select(
        F.col("event_id").cast("string").alias("request_id"), later.alias("evaluation_created_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), metrics.alias("metrics"),
    )


def entries(t: Tables) -> DataFrame:
    return O.materialize(records(t), summaries(t))


SHOW = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SHOW_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


@query("materialize_entry", f"""WITH {RECORDS_SQL} SELECT request_id, conversation_id, {SHOW_SQL.format('request_created_at')} AS request_created_at, {SHOW_SQL.format('evaluation_created_at')} AS evaluation_created_at,
  strftime(request_created_at, '%Y-%m-%d') AS event_date, query_type, status, latency_ms, k FROM entries""")
def materialize_entry(t: Tables) -> DataFrame:
    return entries(t).select(
        "request_id", "conversation_id", F.date_format("request_created_at", SHOW).alias("request_created_at"), F.date_format("evaluation_created_at", SHOW).alias("evaluation_created_at"),
        "event_date", "query_type", "status", "latency_ms", F.col("metrics")["k"].alias("k"),
    )


DAILY_SQL = RECORDS_SQL + """, long AS (SELECT strftime(request_created_at, '%Y-%m-%d') AS event_date, query_type, 'k' AS metric, k::DOUBLE AS value FROM entries
  UNION ALL SELECT strftime(request_created_at, '%Y-%m-%d'), query_type, 'seconds', seconds::DOUBLE FROM entries)"""


@query("daily_summary", f"""WITH {DAILY_SQL} SELECT event_date, query_type, metric, round(avg(value), 6) AS metric_mean, count(*) AS n FROM long GROUP BY ALL
UNION ALL SELECT event_date, NULL, metric, round(avg(value), 6), count(*) FROM long GROUP BY ALL""")
def daily_summary(t: Tables) -> DataFrame:
    return O.daily_means(entries(t))


@query("daily_status", f"WITH {RECORDS_SQL} SELECT strftime(request_created_at, '%Y-%m-%d') AS event_date, status, count(*) AS records FROM entries GROUP BY ALL")
def daily_status(t: Tables) -> DataFrame:
    return O.status_counts(entries(t))


@query("day_partition", f"WITH {RECORDS_SQL} SELECT request_id, status FROM entries WHERE strftime(request_created_at, '%Y-%m-%d') = '2024-01-15'")
def day_partition(t: Tables) -> DataFrame:
    """One day of the stored log: the filter prunes whole partitions."""
    from corpusloom.sources import tables

    path = tables.scratch(t.spark)
    tables.write_daily(entries(t).select("request_id", "status", "event_date"), path)
    return tables.read_day(t.spark, path, "request_id string, status string", "2024-01-15")


# The stored log lacks signups; a later import brings signups and a second version of every error.
UPSERT_SQL = """target AS (SELECT event_id::VARCHAR AS request_id, value AS latency_ms, ts AS version FROM events WHERE event_type <> 'signup'),
raw AS (SELECT CASE WHEN value < 1 THEN ' ' ELSE event_id::VARCHAR END AS request_id, value + 1 AS latency_ms, ts AS version FROM events WHERE event_type IN ('signup', 'error')
  UNION ALL SELECT CASE WHEN value < 1 THEN ' ' ELSE event_id::VARCHAR END, value + 2, ts + INTERVAL 1 HOUR FROM events WHERE event_type IN ('signup', 'error')),
newest AS (SELECT request_id, max_by(latency_ms, version) AS latency_ms FROM raw WHERE trim(request_id) <> '' GROUP BY 1)"""


def target(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") != "signup").select(
        F.col("event_id").cast("string").alias("request_id"), F.col("value").alias("latency_ms"), F.col("ts").alias("version")
    )


def changes(t: Tables) -> DataFrame:
    some = t.events.where(F.col("event_type").isin("signup", "error"))
    request = F.when(F.col("value") < 1, " ").otherwise(F.col("event_id").cast("string")).alias("request_id")
    first = some.select(request, (F.col("value") + 1).alias("latency_ms"), F.col("ts").alias("version"))
    second = some.select(request, (F.col("value") + 2).alias("latency_ms"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("version"))
    return first.unionByName(second)


@query("upsert_result", f"""WITH {UPSERT_SQL} SELECT request_id, round(latency_ms, 6) AS latency_ms FROM newest
UNION ALL SELECT request_id, round(latency_ms, 6) FROM target WHERE request_id NOT IN (SELECT request_id FROM newest)""")
def upsert_result(t: Tables) -> DataFrame:
    return O.upsert(target(t), changes(t), "request_id", ["version"]).select("request_id", F.round("latency_ms", 6).alias("latency_ms"))


@query("upsert_counts", f"""WITH {UPSERT_SQL} SELECT (SELECT count(*) FROM newest WHERE request_id NOT IN (SELECT request_id FROM target)) AS inserted,
  (SELECT count(*) FROM newest WHERE request_id IN (SELECT request_id FROM target)) AS updated, (SELECT count(*) FROM raw WHERE trim(request_id) = '') AS skipped""")
def upsert_counts(t: Tables) -> DataFrame:
    return O.upsert_counts(target(t), changes(t), "request_id")


@query("upsert_failed", f"""WITH {UPSERT_SQL}, usable AS (SELECT *, coalesce(latency_ms <= 60, false) AS ok FROM raw WHERE trim(request_id) <> '')
SELECT request_id, CASE WHEN NOT bool_or(ok) THEN 'failed' WHEN request_id IN (SELECT request_id FROM target) THEN 'updated' ELSE 'inserted' END AS outcome,
  count(*) FILTER (NOT ok) AS failed_rows FROM usable GROUP BY request_id""")
def upsert_failed(t: Tables) -> DataFrame:
    """What became of each request of an import in which slow ones are refused."""
    return O.upsert_outcomes(target(t), changes(t), "request_id", ["version"], F.col("latency_ms") <= 60)[1]


@query("import_quarantine", "SELECT event_id::VARCHAR AS request_id, value AS latency_ms, 'latency_ms out of range' AS reason FROM events WHERE NOT (value >= 0 AND value <= 100)")
def import_quarantine(t: Tables) -> DataFrame:
    """Rows that fail a check go to their own table; the rest of the import goes on."""
    bad = O.quarantine(records(t), (F.col("latency_ms") >= 0) & (F.col("latency_ms") <= 100))[1]
    return bad.select("request_id", "latency_ms", F.lit("latency_ms out of range").alias("reason"))


@query("payload_coercion", """SELECT event_id::VARCHAR AS request_id, CASE WHEN user_id < 10 THEN '' ELSE user_id::VARCHAR END AS conversation_id, CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'unknown' ELSE event_type END AS status,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS context_count FROM events""")
def payload_coercion(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(" ")).alias("request_id"), F.when(F.col("user_id") >= 10, F.col("user_id")).alias("conversation_id"),
        F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type")).alias("status"),
        F.when(F.col("event_type") != "error", F.array("event_type")).alias("actual_contexts"),
    )
    return O.payload(rows).select("request_id", "conversation_id", "status", F.size("actual_contexts").alias("context_count"))


@query("capability_flags", """SELECT event_id, concat_ws('|', CASE WHEN event_type <> 'error' THEN 'has_reference_answer' END, CASE WHEN value > 5 THEN 'has_reference_contexts' END, CASE WHEN user_id > 20 THEN 'has_reference_doc_ids' END) AS capabilities FROM events""")
def capability_flags(t: Tables) -> DataFrame:
    one = F.array(F.lit("x"))
    flags = O.capability_flags(
        F.when(F.col("event_type") != "error", "answer").otherwise(""), F.when(F.col("value") > 5, one), F.when(F.col("user_id") > 20, one)
    )
    return t.events.select("event_id", F.array_join(flags, "|").alias("capabilities"))


@query("metric_failures", """SELECT event_id, CASE WHEN value < 3 AND event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ((value >= 3)::INT + (event_type <> 'error')::INT)::INTEGER AS metric_count,
  concat_ws('|', CASE WHEN value < 3 THEN 'faithfulness' END, CASE WHEN event_type = 'error' THEN 'answer_relevancy' END) AS failed FROM events""")
def metric_failures(t: Tables) -> DataFrame:
    """A metric that fails costs only itself; a request fails when every metric fails."""
    low, broken = F.col("value") < 3, F.col("event_type") == "error"
    names = [F.lit("faithfulness"), F.lit("answer_relevancy")]
    values = F.create_map(names[0], F.when(~low, F.col("value")), names[1], F.when(~broken, F.lit(1.0)))
    errors = F.create_map(names[0], F.when(low, F.lit("TimeoutError: too short")), names[1], F.when(broken, F.lit("RuntimeError: no answer")))
    out = scoring.isolate_failures(values, errors)
    return t.events.select("event_id", out["status"].alias("status"), F.size(out["metrics"]).alias("metric_count"), F.array_join(F.map_keys(out["metric_failures"]), "|").alias("failed"))


@query("retrieved_requests", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND (props->>'k')::INT > 0")
def retrieved_requests(t: Tables) -> DataFrame:
    """Only requests that really retrieved something are evaluated."""
    n = F.get_json_object("props", "$.k").cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = t.events.select("event_id", "event_type", ids.alias("actual_doc_ids"))
    return rows.where((F.size("actual_doc_ids") > 0) & (F.col("event_type") != "error")).select("event_id", "event_type")


ATTEMPTS_SQL = """attempts AS (SELECT event_id, event_type = 'error' AS tool_error, value > 5 AS relevant, value > 10 AS grounded, value > 20 AS useful, (props->>'k')::INT // 25 AS rewrites, (props->>'k')::INT // 20 AS generated FROM events)"""


@query("retry_funnel", f"""WITH {ATTEMPTS_SQL}, x AS (SELECT 'retrieve' AS stage, CASE WHEN tool_error THEN 'decide_retrieve_or_respond' WHEN rewrites >= 2 OR relevant THEN 'generate_answer' ELSE 'rewrite_question' END AS next_step FROM attempts
UNION ALL SELECT 'generate', CASE WHEN generated >= 3 OR grounded THEN 'check_usefulness' ELSE 'generate_answer' END FROM attempts
UNION ALL SELECT 'check', CASE WHEN rewrites >= 2 OR useful THEN '__end__' ELSE 'rewrite_question' END FROM attempts) SELECT stage, next_step, count(*) AS attempts FROM x GROUP BY ALL""")
def retry_funnel(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rewrites, generated = F.floor(k / 25), F.floor(k / 20)
    value = F.col("value")
    steps = F.array(
        F.struct(F.lit("retrieve").alias("stage"), O.next_after_retrieval(F.col("event_type") == "error", rewrites, value > 5).alias("next_step")),
        F.struct(F.lit("generate").alias("stage"), O.next_after_answer(generated, value > 10).alias("next_step")),
        F.struct(F.lit("check").alias("stage"), O.next_after_check(rewrites, value > 20).alias("next_step")),
    )
    return t.events.select(F.explode(steps).alias("s")).groupBy("s.stage", "s.next_step").agg(F.count("*").alias("attempts"))


ERRORS = (
    ("error", "RuntimeError", "No relationships match the provided condition. Cannot form clusters."),
    ("click", "ReadTimeout", "no data"),
    ("view", "RuntimeError", "Request timed out after 120 s"),
    ("signup", "ValueError", "Rate limit reached"),
)
ERROR_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, _, m in ERRORS) + " ELSE 'unexpected value' END"
CLASS_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c, _ in ERRORS) + " ELSE 'KeyError' END"


@query("error_classes", f"""WITH x AS (SELECT {CLASS_SQL} AS c, lower({ERROR_SQL}) AS m FROM events),
y AS (SELECT contains(m, 'cannot form clusters') OR contains(m, 'no clusters found') AS cluster, contains(m, 'connection error') OR contains(m, 'timed out') OR contains(m, 'temporarily unavailable') OR contains(m, 'rate limit') OR lower(c) IN ('apiconnectionerror', 'apitimeouterror', 'connecterror', 'readtimeout', 'timeoutexception') AS transient FROM x)
SELECT NOT cluster AS retriable, CASE WHEN cluster THEN 'cluster_missing' WHEN transient THEN 'transient_runtime' ELSE 'unknown' END AS category, count(*) AS n FROM y GROUP BY ALL""")
def error_classes(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name, message = F.lit("KeyError"), F.lit("unexpected value")
    for event, error, text in ERRORS:
        name = F.when(kind == event, error).otherwise(name)
        message = F.when(kind == event, text).otherwise(message)
    found = Q.error_class(name, message)
    return t.events.groupBy(found["retriable"].alias("retriable"), found["category"].alias("category")).agg(F.count("*").alias("n"))


@query("logit_probability", "SELECT event_id, round(1 / (1 + exp(user_id / 10 - value)), 6) AS p FROM events")
def logit_probability(t: Tables) -> DataFrame:
    from corpusloom.operators.ranking import yes_probability

    return t.events.select("event_id", F.round(yes_probability(F.col("value"), F.col("user_id") / 10), 6).alias("p"))


@query("first_seen_union", """WITH r AS (SELECT user_id, hour(ts) AS round, (props->>'k')::INT AS doc_id, event_id AS rank FROM events)
SELECT user_id, doc_id, min(round)::INTEGER AS first_round, min_by(rank, (round, rank)) AS first_rank FROM r GROUP BY ALL""")
def first_seen_union(t: Tables) -> DataFrame:
    """Ids retrieved over several rounds of a user, each once, by first appearance."""
    from corpusloom.operators.ranking import first_seen

    rows = t.events.select("user_id", F.hour(F.col("ts").cast("timestamp")).alias("round"), F.get_json_object("props", "$.k").cast("int").alias("doc_id"), F.col("event_id").alias("rank"))
    return first_seen(rows, ["user_id"], "doc_id")


# --- streams -------------------------------------------------------------------------------------------------


@query("stream_daily", f"""WITH {RECORDS_SQL} SELECT strftime(request_created_at, '%Y-%m-%d') AS event_date, query_type, count(*) AS requests, round(avg(latency_ms), 6) AS latency_mean FROM records GROUP BY ALL""")
def stream_daily(t: Tables) -> DataFrame:
    return jobs.run_daily(t.spark, t.folder)


@query("stream_daily_closed", f"""WITH {RECORDS_SQL} SELECT strftime(request_created_at, '%Y-%m-%d') AS event_date, query_type, count(*) AS requests, round(avg(latency_ms), 6) AS latency_mean
FROM records WHERE date_trunc('day', request_created_at) + INTERVAL 1 DAY <= (SELECT max(request_created_at) FROM records) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_daily_closed(t: Tables) -> DataFrame:
    """Append mode: days whose end the watermark has passed."""
    return jobs.run_daily_closed(t.spark, t.folder)


@query("stream_dedupe", "SELECT event_id::VARCHAR AS request_id, event_type AS query_type, value AS latency_ms FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """The log sent twice arrives once."""
    return jobs.run_dedupe(t.spark, t.folder).select("request_id", "query_type", "latency_ms")


@query("stream_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
SELECT user_id::VARCHAR AS conversation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS requests FROM y GROUP BY user_id, s""")
def stream_sessions(t: Tables) -> DataFrame:
    return jobs.run_sessions(t.spark, t.folder)


@query("stream_join", f"""WITH {RECORDS_SQL} SELECT request_id, status, latency_ms FROM records JOIN summaries USING (request_id)""")
def stream_join(t: Tables) -> DataFrame:
    return jobs.run_join(t.spark, t.folder).select("request_id", "status", "latency_ms")


@query("stream_upsert", "SELECT user_id::VARCHAR AS conversation_id, max(event_id) AS last_event, max_by(value, event_id) AS latency_ms FROM events GROUP BY user_id")
def stream_upsert(t: Tables) -> DataFrame:
    return jobs.run_upsert(t.spark, t.folder)


@query("stream_append_log", f"WITH {RECORDS_SQL} SELECT request_id, strftime(request_created_at, '%Y-%m-%d') AS event_date, status FROM entries")
def stream_append_log(t: Tables) -> DataFrame:
    return jobs.run_append(t.spark, t.folder)


@query("stream_pairs", """WITH talk AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, user_turn, turn AS ai_turn FROM talk WHERE role = 'assistant' AND user_turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, user_turn ORDER BY turn) = 1""")
def stream_pairs(t: Tables) -> DataFrame:
    return jobs.run_pairs(t.spark, t.folder)
