"""Registered queries: sampling weights, chunk budgets, batch limits, pairing, type counts. A dataset is a language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import allocation as A
from corpusloom.functions import querytype as Q
from corpusloom.operators import batches as B
from corpusloom.operators import sampling as S
from corpusloom.plans.registry import PARENTS_SQL, Tables, query
from corpusloom.session import durable

BUDGET = 400
NOW = "2024-02-01 00:00:00"
UNIT_SQL = "((('0x' || substr(md5({0}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

FILES_SQL = PARENTS_SQL + """,
plan_files AS (SELECT lang AS dataset_id, file_id, count(*) AS parent_count FROM parents GROUP BY ALL),
weighed AS (SELECT dataset_id, file_id, parent_count,
  greatest(exp(-coalesce(greatest((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6::DOUBLE / 86400, 0), 30.0::DOUBLE) / 30), 1e-8) * greatest(sqrt(parent_count::DOUBLE), 1) AS weight
  FROM plan_files LEFT JOIN events ON event_id = file_id)"""


def plan_files(t: Tables) -> DataFrame:
    return t.parents().groupBy(F.col("lang").alias("dataset_id"), "file_id").agg(F.count("*").alias("parent_count"))


def weighed(t: Tables) -> DataFrame:
    """A file's creation time is that of the event with its number."""
    dates = t.events.select(F.col("event_id").alias("file_id"), F.col("ts").alias("created_at"))
    files = plan_files(t).join(dates, "file_id", "left")
    return files.withColumn("weight", S.recency_weight(F.col("created_at"), F.col("parent_count"), NOW, 30.0))


@query("doc_weight", f"WITH {FILES_SQL} SELECT dataset_id, file_id, parent_count, round(weight, 6) AS weight FROM weighed")
def doc_weight(t: Tables) -> DataFrame:
    return weighed(t).select("dataset_id", "file_id", "parent_count", F.round("weight", 6).alias("weight"))


@query("weighted_sample", f"""WITH {FILES_SQL} SELECT dataset_id, file_id, rank::INTEGER AS draw_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY -ln({UNIT_SQL.format("'7|' || file_id")}) / weight, file_id) AS rank FROM weighed) WHERE rank <= 20""")
def weighted_sample(t: Tables) -> DataFrame:
    return S.weighted_sample(weighed(t), ["dataset_id"], "file_id", "weight", 20, "7").select("dataset_id", "file_id", "draw_rank")


@query("uniform_sample", f"""WITH {PARENTS_SQL} SELECT lang, parent_id, rank::INTEGER AS draw_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || parent_id), parent_id) AS rank FROM parents) WHERE rank <= 25""")
def uniform_sample(t: Tables) -> DataFrame:
    return S.uniform_sample(t.parents().select("lang", "parent_id"), ["lang"], "parent_id", 25, "7").select("lang", "parent_id", "draw_rank")


QUOTA_SQL = FILES_SQL + f""",
totals AS (SELECT dataset_id, (least({BUDGET}, sum(parent_count)) >= count(*))::INT AS base, least({BUDGET}, sum(parent_count)) - count(*) * (least({BUDGET}, sum(parent_count)) >= count(*))::INT AS left_over FROM plan_files GROUP BY 1),
units AS (SELECT f.*, base, left_over, unnest(range(0, parent_count - base)) AS unit FROM plan_files f JOIN totals USING (dataset_id)),
arrivals AS (SELECT *, round(sum(-ln({UNIT_SQL.format("'7|' || file_id || '|' || unit")}) / greatest(power((parent_count - base - unit)::DOUBLE, 0.7::DOUBLE), 1e-8)) OVER (PARTITION BY dataset_id, file_id ORDER BY unit ROWS UNBOUNDED PRECEDING), 12) AS arrival FROM units),
won AS (SELECT dataset_id, file_id, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY arrival, file_id, unit) AS place FROM arrivals) WHERE place <= left_over GROUP BY ALL),
quotas AS (SELECT f.dataset_id, f.file_id, parent_count, (base + coalesce(won, 0))::INTEGER AS allocated_quota FROM plan_files f JOIN totals USING (dataset_id) LEFT JOIN won ON won.file_id = f.file_id)"""


def quotas(t: Tables) -> DataFrame:
    return S.chunk_quotas(plan_files(t), "dataset_id", "file_id", "parent_count", BUDGET, 0.7, "7")


@query("chunk_budget", f"WITH {QUOTA_SQL} SELECT dataset_id, file_id, parent_count, allocated_quota FROM quotas")
def chunk_budget(t: Tables) -> DataFrame:
    return quotas(t)


PLAN_SQL = QUOTA_SQL + """,
picked AS (SELECT q.dataset_id, q.file_id, parent_id, allocated_quota, (place - 1)::INTEGER AS sample_index, length(text)::INTEGER AS chars, trim(text) <> '' AS filled FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY md5('11|' || parent_id), parent_id) AS place FROM parents) p JOIN quotas q ON q.file_id = p.file_id WHERE place <= allocated_quota),
plan AS (SELECT dataset_id, file_id, any_value(allocated_quota) AS allocated_quota, count(*) AS chunk_count, sum(chars)::BIGINT AS total_chunk_chars, round(avg(chars), 6) AS avg_chunk_chars, max(chars) AS max_chunk_chars FROM picked GROUP BY ALL),
safe AS (SELECT *, min(avg_chunk_chars) OVER (PARTITION BY dataset_id, allocated_quota) AS safe_avg FROM plan),
limits AS (SELECT *, CASE WHEN total_chunk_chars <= safe_avg * allocated_quota * 1.1::DOUBLE THEN 'within_safe_batch_budget' ELSE 'dynamic_chars' END AS limit_reason,
  (CASE WHEN total_chunk_chars <= safe_avg * allocated_quota * 1.1::DOUBLE THEN least(allocated_quota, 3)
    ELSE least(least(allocated_quota, 3), greatest(floor(safe_avg * allocated_quota / greatest(avg_chunk_chars, 1)), 1)) END)::INTEGER AS effective_chunk_limit FROM safe),
placed AS (SELECT p.*, (sample_index // effective_chunk_limit + 1)::INTEGER AS sub_batch_index, ceil(chunk_count / effective_chunk_limit)::INTEGER AS sub_batch_count FROM picked p JOIN limits l ON l.file_id = p.file_id),
subs AS (SELECT dataset_id, file_id, sub_batch_index, sub_batch_count, count(*) AS chunk_count, sum(chars)::BIGINT AS total_chunk_chars, round(avg(chars), 6) AS avg_chunk_chars, max(chars) AS max_chunk_chars,
  count(DISTINCT parent_id) AS parent_count, count(*) FILTER (filled) AS populated, count(DISTINCT file_id) AS file_count FROM placed GROUP BY ALL)"""


def picked(t: Tables) -> DataFrame:
    """The plan's chunks, written once: statistics, limits and batches all start from them."""
    chunks = t.parents().select(F.col("lang").alias("dataset_id"), "file_id", "parent_id", F.length("text").alias("chars"), (F.trim("text") != "").alias("filled"))
    return durable(S.pick_chunks(chunks, quotas(t), ["dataset_id", "file_id"], "parent_id", BUDGET, "11"))


def limits_of(chosen: DataFrame) -> DataFrame:
    stats = B.plan_stats(chosen, ["dataset_id", "file_id", "allocated_quota"])
    return B.dynamic_limits(stats, "dataset_id", hard_cap=3)


@query("plan_statistics", f"WITH {PLAN_SQL} SELECT * FROM plan")
def plan_statistics(t: Tables) -> DataFrame:
    return B.plan_stats(picked(t), ["dataset_id", "file_id", "allocated_quota"])


@query("dynamic_limit", f"WITH {PLAN_SQL} SELECT dataset_id, file_id, allocated_quota, limit_reason, effective_chunk_limit FROM limits")
def dynamic_limit(t: Tables) -> DataFrame:
    return limits_of(picked(t)).select("dataset_id", "file_id", "allocated_quota", "limit_reason", "effective_chunk_limit")


def placed_and_batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    chosen = picked(t)
    return B.sub_batches(chosen, limits_of(chosen), ["dataset_id", "file_id"])


@query("sub_batches", f"WITH {PLAN_SQL} SELECT dataset_id, file_id, sub_batch_index, sub_batch_count, chunk_count, total_chunk_chars, avg_chunk_chars, max_chunk_chars FROM subs")
def sub_batches(t: Tables) -> DataFrame:
    return placed_and_batches(t)[1]


PAIRING_SQL = PLAN_SQL + """,
fcounts AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY seq) AS i FROM (SELECT dataset_id, file_id AS seq, max(sub_batch_count)::BIGINT AS n FROM placed GROUP BY ALL)),
walk AS (SELECT dataset_id, i, NULL::BIGINT AS base_seq, 0::BIGINT AS base_n, 0::BIGINT AS base_left, seq, 0::BIGINT AS pairs, seq AS end_seq, n AS end_n, n AS end_left, 0::BIGINT AS through FROM fcounts WHERE i = 1
  UNION ALL SELECT f.dataset_id, f.i, w.end_seq, w.end_n, w.end_left, f.seq, least(w.end_left, f.n),
    CASE WHEN f.n > w.end_left THEN f.seq ELSE w.end_seq END, CASE WHEN f.n > w.end_left THEN f.n ELSE w.end_n END, abs(w.end_left - f.n), w.through + least(w.end_left, f.n)
  FROM walk w JOIN fcounts f ON f.dataset_id = w.dataset_id AND f.i = w.i + 1),
pairing AS (SELECT dataset_id, through - pairs + k AS batch_index, 'multi_file' AS batch_mode, base_seq, base_n - base_left + k AS base_no, seq AS partner_seq, k AS partner_no FROM (SELECT *, unnest(range(1, pairs + 1)) AS k FROM walk)
  UNION ALL SELECT dataset_id, through + k, 'single_file_fallback', end_seq, end_n - end_left + k, NULL, NULL FROM (
    SELECT *, unnest(range(1, end_left + 1)) AS k FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY i DESC) = 1)))"""


@query("multi_file_pairs", f"WITH RECURSIVE {PAIRING_SQL} SELECT * FROM pairing")
def multi_file_pairs(t: Tables) -> DataFrame:
    batches = placed_and_batches(t)[1]
    files = batches.groupBy("dataset_id", F.col("file_id").alias("seq")).agg(F.max("sub_batch_count").alias("n"))
    return B.pair_batches(durable(files), "dataset_id", "seq", "n")


@query("topup_alloc", f"""WITH {PLAN_SQL}, x AS (SELECT dataset_id, file_id, allocated_quota, floor(150 * greatest(allocated_quota, 1) / (sum(greatest(allocated_quota, 1)) OVER (PARTITION BY dataset_id)))::INTEGER AS share FROM plan),
y AS (SELECT *, 150 - sum(share) OVER (PARTITION BY dataset_id) AS left_over, row_number() OVER (PARTITION BY dataset_id ORDER BY allocated_quota DESC, file_id) AS place FROM x)
SELECT dataset_id, file_id, allocated_quota, (share + (place <= left_over)::INT)::INTEGER AS topup_count FROM y""")
def topup_alloc(t: Tables) -> DataFrame:
    plan = B.plan_stats(picked(t), ["dataset_id", "file_id", "allocated_quota"]).select("dataset_id", "file_id", "allocated_quota")
    return S.topup_counts(plan, "dataset_id", "file_id", 150, seq="file_id")


@query("topup_pick", f"""WITH {PLAN_SQL}, x AS (SELECT dataset_id, file_id, allocated_quota, floor(150 * greatest(allocated_quota, 1) / (sum(greatest(allocated_quota, 1)) OVER (PARTITION BY dataset_id)))::INTEGER AS share FROM plan),
y AS (SELECT *, 150 - sum(share) OVER (PARTITION BY dataset_id) AS left_over, row_number() OVER (PARTITION BY dataset_id ORDER BY allocated_quota DESC, file_id) AS place FROM x),
asked AS (SELECT dataset_id, file_id, (share + (place <= left_over)::INT)::INTEGER AS wanted FROM y),
fresh AS (SELECT file_id, parent_id, row_number() OVER (PARTITION BY file_id ORDER BY md5('13|' || parent_id), parent_id) AS pick FROM parents WHERE parent_id NOT IN (SELECT parent_id FROM picked)),
a AS (SELECT dataset_id, file_id, parent_id, pick FROM asked JOIN fresh USING (file_id) WHERE pick <= wanted),
have AS (SELECT file_id, count(*) AS have FROM a GROUP BY 1),
pools AS (SELECT file_id, parent_id, count(*) OVER (PARTITION BY file_id) AS pool, row_number() OVER (PARTITION BY file_id ORDER BY md5('13-pool|' || parent_id), parent_id) AS at FROM parents),
d AS (SELECT dataset_id, file_id, unnest(range(coalesce(have, 0) + 1, wanted + 1)) AS pick FROM asked LEFT JOIN have USING (file_id)),
b AS (SELECT d.dataset_id, d.file_id, p.parent_id, d.pick FROM d JOIN pools p ON p.file_id = d.file_id AND p.at = floor({UNIT_SQL.format("'13-repeat|' || d.dataset_id || '|' || d.file_id || '|' || d.pick")} * p.pool) + 1)
SELECT dataset_id, file_id, parent_id, pick::INTEGER AS pick, false AS repeated FROM a UNION ALL SELECT dataset_id, file_id, parent_id, pick::INTEGER, true FROM b""")
def topup_pick(t: Tables) -> DataFrame:
    chosen = picked(t)
    plan = B.plan_stats(chosen, ["dataset_id", "file_id", "allocated_quota"]).select("dataset_id", "file_id", "allocated_quota")
    wanted = S.topup_counts(plan, "dataset_id", "file_id", 150, seq="file_id")
    chunks = t.parents().select(F.col("lang").alias("dataset_id"), "file_id", "parent_id")
    return S.topup_chunks(chunks, chosen, wanted, ["dataset_id", "file_id"], "parent_id", 150, "13")


# --- type counts ---------------------------------------------------------------------------------------------

TYPE_LIST = "['single_hop_specific','single_hop_abstract','multi_hop_specific','multi_hop_abstract']"


def alloc_sql(source: str, keys: str, total: str, shares: str) -> str:
    """CTE body: one row per (keys, type) with its largest-remainder count."""
    return f"""SELECT {keys}, t, qt, (base + (place <= {total} - total_base)::INT)::INTEGER AS c FROM (
  SELECT *, sum(base) OVER (PARTITION BY {keys}) AS total_base, row_number() OVER (PARTITION BY {keys} ORDER BY rest DESC, t) AS place FROM (
    SELECT *, floor({total} * share) AS base, {total} * share - floor({total} * share) AS rest FROM (
      SELECT {keys}, {total}, t, {TYPE_LIST}[t] AS qt, ({shares})[t] AS share FROM (SELECT *, unnest(range(1, 5)) AS t FROM {source}))))"""


FOCUS = "[0.1::DOUBLE, 0.1::DOUBLE, 0.4::DOUBLE, 0.4::DOUBLE]"


def long_counts(df: DataFrame, keys: list[str], counts: str, value: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in Q.QUERY_TYPES])
    return df.select(*keys, F.explode(F.arrays_zip(names.alias("query_type"), F.col(counts).alias("v"))).alias("x")).select(
        *keys, F.col("x.query_type").alias("query_type"), F.col("x.v").alias(value)
    )


@query("type_alloc", f"WITH {FILES_SQL}, a AS ({alloc_sql('plan_files', 'dataset_id, file_id', 'parent_count', FOCUS)}) SELECT dataset_id, file_id, qt AS query_type, c AS requested FROM a")
def type_alloc(t: Tables) -> DataFrame:
    counted = plan_files(t).withColumn("counts", A.allocate(F.col("parent_count"), A.profile("multihop_focus")))
    return long_counts(counted, ["dataset_id", "file_id"], "counts", "requested").withColumn("requested", F.col("requested").cast("int"))


@query("distribution_normalize", f"""WITH raw AS (SELECT source AS scope_id, [count(*) FILTER (lang = 'en')::VARCHAR, 'n/a', (count(*) FILTER (lang = 'de') - 6)::VARCHAR, count(*) FILTER (lang = 'fr' AND length(text) > 3000)::VARCHAR] AS v FROM documents GROUP BY 1),
x AS (SELECT scope_id, list_transform(v, lambda s: greatest(coalesce(try_cast(s AS DOUBLE), 0), 0)) AS v FROM raw)
SELECT scope_id, {TYPE_LIST}[t] AS query_type, round(CASE WHEN list_sum(v) > 0 THEN v[t] / list_sum(v) ELSE ({FOCUS})[t] END, 6) AS share FROM (SELECT *, unnest(range(1, 5)) AS t FROM x)""")
def distribution_normalize(t: Tables) -> DataFrame:
    lang = lambda x: F.count_if(F.col("lang") == x)
    raw = t.documents.groupBy(F.col("source").alias("scope_id")).agg(
        F.array(
            lang("en").cast("string"), F.lit("n/a"), (lang("de") - 6).cast("string"),
            F.count_if((F.col("lang") == "fr") & (F.length("text") > 3000)).cast("string"),
        ).alias("v")
    )
    shares = raw.select("scope_id", A.normalized(F.col("v")).alias("shares"))
    return long_counts(shares, ["scope_id"], "shares", "share").withColumn("share", F.round("share", 6))


@query("type_probe", f"""WITH {PLAN_SQL} SELECT dataset_id, file_id, sub_batch_index, parent_count, populated, parent_count >= 2 AND populated >= 2 AS multi_specific, parent_count >= 2 AND populated >= 3 AS multi_abstract,
  concat_ws('|', CASE WHEN NOT (parent_count >= 2 AND populated >= 2) THEN 'insufficient_multihop_evidence' END, CASE WHEN NOT (parent_count >= 2 AND populated >= 3) THEN 'insufficient_multihop_cluster_signals' END) AS reasons FROM subs""")
def type_probe(t: Tables) -> DataFrame:
    rows = probed(t)
    return rows.select(
        "dataset_id", "file_id", "sub_batch_index", "parent_count", "populated",
        F.get("available", F.lit(2)).alias("multi_specific"), F.get("available", F.lit(3)).alias("multi_abstract"),
        F.array_join(A.unavailable_reason(F.col("available")), "|").alias("reasons"),
    )


def probed(t: Tables) -> DataFrame:
    placed = placed_and_batches(t)[0]
    signals = placed.groupBy("dataset_id", "file_id", "sub_batch_index").agg(
        F.count("*").alias("chunk_count"), F.count_if("filled").alias("populated"), F.countDistinct("parent_id").alias("parent_count")
    )
    return signals.withColumn("available", A.available_types(F.col("parent_count"), F.col("populated"), F.lit(1)))


# Flags drawn from each file's name, so that every combination of available types occurs.
FLAG_SQL = "[substr(md5('a' || file_id), {i}, 1) < '8' FOR i IN [1, 2, 3, 4]]"
REALLOC_SQL = FILES_SQL + f""",
flags AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: substr(md5('a' || file_id), i, 1) < '8') AS av FROM plan_files),
req AS ({alloc_sql('flags', 'dataset_id, file_id, av', 'parent_count', FOCUS)}),
events AS (SELECT dataset_id, file_id, qt AS source, c, CASE qt
    WHEN 'multi_hop_abstract' THEN CASE WHEN av[3] THEN 'multi_hop_specific' WHEN av[2] THEN 'single_hop_abstract' WHEN av[1] THEN 'single_hop_specific' END
    WHEN 'multi_hop_specific' THEN CASE WHEN av[1] THEN 'single_hop_specific' WHEN av[2] THEN 'single_hop_abstract' WHEN av[4] THEN 'multi_hop_abstract' END
    WHEN 'single_hop_abstract' THEN CASE WHEN av[1] THEN 'single_hop_specific' WHEN av[4] THEN 'multi_hop_abstract' WHEN av[3] THEN 'multi_hop_specific' END
    ELSE CASE WHEN av[4] THEN 'multi_hop_abstract' WHEN av[3] THEN 'multi_hop_specific' WHEN av[2] THEN 'single_hop_abstract' END END AS target,
    CASE WHEN NOT list_contains(av, true) THEN 'nothing_available'
      WHEN qt = 'single_hop_specific' OR (qt = 'single_hop_abstract' AND NOT av[1]) OR (qt = 'multi_hop_specific' AND NOT av[1] AND NOT av[2]) THEN 'fallback_to_any_available_type' ELSE 'unavailable_for_batch' END AS reason
  FROM req WHERE NOT av[t] AND c > 0)"""


def reallocated(t: Tables) -> DataFrame:
    flag = lambda i: F.substring(F.md5(F.concat(F.lit("a"), F.col("file_id").cast("string"))), i, 1) < "8"
    rows = plan_files(t).select("dataset_id", "file_id", A.allocate(F.col("parent_count"), A.profile("multihop_focus")).alias("requested"), F.array(*[flag(i) for i in (1, 2, 3, 4)]).alias("available"))
    rows = rows.withColumn("requested", F.transform("requested", lambda x: x.cast("int")))
    rows = rows.withColumn("events", A.moves(F.col("requested"), F.col("available")))
    return rows.withColumn("effective", A.moved_counts(F.col("requested"), F.col("available"), F.col("events")))


@query("type_realloc", f"""WITH {REALLOC_SQL}, gained AS (SELECT file_id, target, sum(c) AS g FROM events WHERE target IS NOT NULL GROUP BY ALL)
SELECT r.dataset_id, r.file_id, qt AS query_type, ((CASE WHEN av[t] THEN c ELSE 0 END) + coalesce(g, 0))::INTEGER AS effective FROM req r LEFT JOIN gained g ON g.file_id = r.file_id AND g.target = r.qt""")
def type_realloc(t: Tables) -> DataFrame:
    return long_counts(reallocated(t), ["dataset_id", "file_id"], "effective", "effective").withColumn("effective", F.col("effective").cast("int"))


@query("fallback_summary", f"WITH {REALLOC_SQL} SELECT concat_ws('->', source, coalesce(target, 'none')) AS path, reason, sum(c)::BIGINT AS moved FROM events GROUP BY ALL")
def fallback_summary(t: Tables) -> DataFrame:
    events = reallocated(t).select(F.explode("events").alias("e"))
    path = F.concat_ws("->", F.col("e.source"), F.coalesce("e.target", F.lit("none")))
    return events.groupBy(path.alias("path"), F.col("e.reason").alias("reason")).agg(F.sum("e.moved").alias("moved"))


PREPARE_SQL = PLAN_SQL + f""",
batch AS (SELECT dataset_id, file_id, sub_batch_index, chunk_count, [true, true, parent_count >= 2 AND populated >= 2, parent_count >= 2 AND populated >= 3] AS av,
  substr(md5('e' || file_id || '-' || sub_batch_index), 1, 1) < '4' AS cluster_error, substr(md5('e' || file_id || '-' || sub_batch_index), 2, 1) < '4' AS second_error FROM subs),
req AS ({alloc_sql('batch', 'dataset_id, file_id, sub_batch_index, av, cluster_error, second_error', 'chunk_count', '[0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE]')}),
pv AS (SELECT dataset_id, file_id, sub_batch_index, any_value(av) AS av, any_value(cluster_error) AS cluster_error, any_value(second_error) AS second_error,
  sum(c) FILTER (t = 1) AS a, sum(c) FILTER (t = 2) AS b, sum(c) FILTER (t = 3) AS c, sum(c) FILTER (t = 4) AS d FROM req GROUP BY 1, 2, 3),
first AS (SELECT *, a + (CASE WHEN av[3] THEN 0 ELSE c END) AS a1, b + (CASE WHEN NOT av[4] AND NOT av[3] THEN d ELSE 0 END) AS b1,
  CASE WHEN av[3] THEN c + (CASE WHEN av[4] THEN 0 ELSE d END) ELSE 0 END AS c1, CASE WHEN av[4] THEN d ELSE 0 END AS d1 FROM pv)"""


@query("batch_preparation", f"""WITH {PREPARE_SQL} SELECT dataset_id, file_id, sub_batch_index,
  (CASE WHEN cluster_error THEN a1 + c1 ELSE a1 END)::INTEGER AS single_hop_specific, (CASE WHEN cluster_error THEN b1 + d1 ELSE b1 END)::INTEGER AS single_hop_abstract,
  (CASE WHEN cluster_error THEN 0 ELSE c1 END)::INTEGER AS multi_hop_specific, (CASE WHEN cluster_error THEN 0 ELSE d1 END)::INTEGER AS multi_hop_abstract, cluster_error AND second_error AS rejected FROM first""")
def batch_preparation(t: Tables) -> DataFrame:
    """Allocate, probe, move; batches whose generation meets a cluster error move once more to single-hop types."""
    draw = lambda i: F.substring(F.md5(F.concat(F.lit("e"), F.concat_ws("-", "file_id", "sub_batch_index"))), i, 1) < "4"
    message = F.when(draw(1), "No relationships match the provided condition. Cannot form clusters.").otherwise("")
    rows = probed(t).withColumn("requested", F.transform(A.allocate(F.col("chunk_count"), A.profile("balanced")), lambda x: x.cast("int")))
    rows = rows.withColumn("events", A.moves(F.col("requested"), F.col("available")))
    rows = rows.withColumn("effective", A.moved_counts(F.col("requested"), F.col("available"), F.col("events")))
    failed = ~Q.error_class(F.lit("RuntimeError"), message)["retriable"]
    singles = F.array(F.lit(True), F.lit(True), F.lit(False), F.lit(False))
    rows = rows.withColumn("failed", failed).withColumn("again", A.moves(F.col("effective"), singles, "secondary_"))
    rows = rows.withColumn("final", F.when(F.col("failed"), A.moved_counts(F.col("effective"), singles, F.col("again"))).otherwise(F.col("effective")))
    return rows.select(
        "dataset_id", "file_id", "sub_batch_index",
        *[F.get("final", F.lit(i)).cast("int").alias(n) for i, n in enumerate(Q.QUERY_TYPES)],
        (F.col("failed") & draw(2)).alias("rejected"),
    )
