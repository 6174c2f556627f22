"""Online evaluation log: record building, payload coercion, keyed upsert, daily roll-up, retry routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

from corpusloom.operators.registry_ops import latest  # noqa: F401  (also used by stream sinks)


def upsert(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Target after applying changes: last change per key wins, blank keys are skipped, other rows stay."""
    usable = changes.where(F.col(key).isNotNull() & (strip(F.col(key).cast("string")) != ""))
    newest = latest(usable, [key], list(order)).select(*target.columns)
    kept = target.join(newest.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(newest)


def upsert_counts(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated and skipped (blank key) counts."""
    blank = F.col(key).isNull() | (strip(F.col(key).cast("string")) == "")
    keys = changes.where(~blank).select(key).distinct()
    known = target.select(key, F.lit(1).alias("_known"))
    joined = keys.join(known, key, "left")
    counts = joined.agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known").isNotNull()).alias("updated"))
    skipped = changes.agg(F.count_if(blank).alias("skipped"))
    return counts.select("inserted", "updated", skipped.scalar().alias("skipped"))


def upsert_outcomes(target: DataFrame, changes: DataFrame, key: str, order: Sequence[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """(target after the changes, one row per key with ``outcome`` inserted, updated or failed, and ``failed_rows``).

    Changes that are not ``valid`` (or of which that is unknown) fail alone: other changes of the same key still count, and
    its outcome then is theirs. Blank keys are skipped. The import as a whole never fails for a row of it.
    """
    ok = F.coalesce(valid, F.lit(False))
    usable = changes.where(F.col(key).isNotNull() & (strip(F.col(key).cast("string")) != "")).withColumn("_ok", ok)
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    keys = usable.groupBy(key).agg(F.bool_or("_ok").alias("_any"), F.count_if(~F.col("_ok")).alias("failed_rows"))
    told = F.when(~F.col("_any"), "failed").when(F.col("_known"), "updated").otherwise("inserted")
    outcomes = keys.join(known, key, "left").select(key, told.alias("outcome"), "failed_rows")
    return upsert(target, usable.where("_ok").drop("_ok"), key, order), outcomes


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): bad rows go to their own table and do not fail the batch."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


# Columns of the log by default value.
BLANK_TEXT = ("conversation_id", "thread_id", "event_date", "request_created_at", "evaluation_created_at", "user_input", "actual_response")
UNKNOWN_TEXT = ("query_type", "hop_count", "abstraction_level", "query_type_source", "status")
LISTS = ("actual_contexts", "actual_doc_ids", "actual_file_ids", "reference_contexts", "reference_context_ids", "skipped_metrics", "query_type_reasons", "metric_names")


def payload(entries: DataFrame) -> DataFrame:
    """Coerce a log entry before insert: trimmed id, blank or "unknown" texts, empty lists. Absent columns stay absent."""
    out = {}
    for name in entries.columns:
        col = F.col(name)
        if name == "request_id":
            out[name] = strip(F.coalesce(col.cast("string"), F.lit("")))
        elif name in BLANK_TEXT:
            out[name] = F.coalesce(col.cast("string"), F.lit(""))
        elif name in UNKNOWN_TEXT:
            out[name] = F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit("unknown"))
        elif name in LISTS:
            out[name] = F.coalesce(col, F.array().cast("array<string>"))
    return entries.withColumns(out)


def materialize(records: DataFrame, summaries: DataFrame, key: str = "request_id") -> DataFrame:
    """One log entry per request: the record, its summary, and the event date taken from the record."""
    joined = records.join(summaries, key)
    return joined.withColumn("event_date", F.date_format("request_created_at", "yyyy-MM-dd"))


def numeric_metrics(entries: DataFrame, keys: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """(keys…, metric, value): one row per numeric entry of a map<string,string>; others are skipped."""
    rows = entries.select(*keys, F.explode(metrics).alias("metric", "raw"))
    return rows.select(*keys, "metric", F.expr("try_cast(raw AS double)").alias("value")).where(F.col("value").isNotNull())


def daily_means(entries: DataFrame) -> DataFrame:
    """(event_date, query_type, metric, metric_mean, n): both grains in one pass; null query_type = all types."""
    kind = entries.withColumn("query_type", F.coalesce(F.nullif("query_type", F.lit("")), F.lit("unknown")))
    rows = numeric_metrics(kind, ["event_date", "query_type"])
    sets = [["event_date", "query_type", "metric"], ["event_date", "metric"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("event_date"), F.col("query_type"), F.col("metric"))
    return grouped.agg(F.round(F.avg("value"), 6).alias("metric_mean"), F.count("*").alias("n"))


def status_counts(entries: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    return entries.groupBy("event_date", status.alias("status")).agg(F.count("*").alias("records"))


def capability_flags(answer: Column, contexts: Column, context_ids: Column) -> Column:
    filled = lambda c: F.size(F.coalesce(c, F.array())) > 0
    return F.array_compact(
        F.array(
            F.when(F.coalesce(answer, F.lit("")) != "", F.lit("has_reference_answer")),
            F.when(filled(contexts), F.lit("has_reference_contexts")),
            F.when(filled(context_ids), F.lit("has_reference_doc_ids")),
        )
    )


def next_after_retrieval(tool_error: Column, rewrites: Column, relevant: Column, max_rewrite: int = 2) -> Column:
    return (
        F.when(tool_error, "decide_retrieve_or_respond")
        .when(rewrites >= max_rewrite, "generate_answer")
        .when(relevant, "generate_answer")
        .otherwise("rewrite_question")
    )


def next_after_answer(generated: Column, grounded: Column, max_generate: int = 3) -> Column:
    return F.when((generated >= max_generate) | grounded, "check_usefulness").otherwise("generate_answer")


def next_after_check(rewrites: Column, useful: Column, max_rewrite: int = 2) -> Column:
    return F.when((rewrites >= max_rewrite) | useful, "__end__").otherwise("rewrite_question")
