"""Structured Streaming twins of the online-log jobs.

Each job is a transformation of a stream plus a sink; the transformations are the batch ones wherever Spark allows
it. The ``run_*`` functions drive one job over the events table until its input is used up and hand back the result
table, which is how tests and registered queries use them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.registry_ops import latest
from corpusloom.sources.tables import scratch

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def source(spark: SparkSession, folder: str, table: str = "events", schema: str = EVENT_SCHEMA, files_at_once: int | None = None) -> DataFrame:
    """Files of one table as a stream, on request so many in a batch. The table is files or folders of files."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    rows = reader.parquet(f"{folder.rstrip('/')}/{table}*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def request_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("conversation_id"),
        F.col("ts").alias("request_created_at"), F.col("value").alias("latency_ms"), F.col("event_type").alias("query_type"),
    )


def request_summaries(events: DataFrame) -> DataFrame:
    later = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000000).cast("long"))
    return events.select(
        F.col("event_id").cast("string").alias("request_id"), later.alias("evaluation_created_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )


# --- transformations -----------------------------------------------------------------------------------------


def daily(records: DataFrame, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests and mean latency per day and type; rows later than the watermark are dropped and counted by Spark.

    With ``slide`` windows of a day begin at every such step and ``window_start`` tells them apart. In append mode a window
    comes out once, when the watermark has passed its end, and its state is freed; in complete mode all of them stay.
    """
    window = F.window("request_created_at", "1 day", slide) if slide else F.window("request_created_at", "1 day")
    grouped = records.withWatermark("request_created_at", delay).groupBy(window.alias("w"), "query_type")
    started = [F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start")] if slide else []
    return grouped.agg(F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 6).alias("latency_mean")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("event_date"), *started, "query_type", "requests", "latency_mean"
    )


def once(records: DataFrame, key: str = "request_id", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a request that arrive within the delay; state older than that is forgotten."""
    return records.withWatermark("request_created_at", delay).dropDuplicatesWithinWatermark([key])


def sessions(records: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    window = F.session_window("request_created_at", gap)
    grouped = records.withWatermark("request_created_at", delay).groupBy(window.alias("w"), "conversation_id")
    return grouped.agg(F.count("*").alias("requests")).select(
        "conversation_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "requests"
    )


def records_with_summaries(records: DataFrame, summaries: DataFrame, within: str = "1 hour") -> DataFrame:
    """A record meets its summary if that comes within the bound; both sides forget older rows."""
    left = records.withWatermark("request_created_at", within)
    right = summaries.withColumnRenamed("request_id", "_id").withWatermark("evaluation_created_at", within)
    bound = F.expr(f"_id = request_id AND evaluation_created_at BETWEEN request_created_at AND request_created_at + INTERVAL {within}")
    return left.join(right, bound).drop("_id")


def paired(turns: list[tuple[int, str]]) -> dict[int, int]:
    """Answer -> question over turns in order: each question is answered by the first answer after it."""
    waiting, found = None, {}
    for turn, role in turns:
        if role == "user":
            waiting = turn
        elif waiting is not None:
            found[turn] = waiting
            waiting = None
    return found


class Pairing(StatefulProcessor):
    """Pairs each answer with the latest unanswered question of its conversation, in whatever order the turns arrive.

    The state holds a role per turn, no texts. Turns that come late may change pairs told before; so what comes out are
    changes: a pair that holds now, or an answer that has lost its question.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn long", "role string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.turns.iterator()} if self.turns.exists() else {}
        before = paired(sorted(known.items()))
        for some in rows:
            for turn, role in zip(some["turn"], some["role"]):
                if pd.notna(turn) and role in ("user", "assistant"):
                    known[int(turn)] = role
                    self.turns.updateValue((int(turn),), (role,))
        after = paired(sorted(known.items()))
        changed = [(key[0], turn, after.get(turn)) for turn in sorted(before.keys() | after.keys()) if before.get(turn) != after.get(turn)]
        yield pd.DataFrame(changed, columns=["conv_id", "ai_turn", "user_turn"]).astype({"user_turn": "Int64"})

    def close(self) -> None:
        pass


def pairs(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of the batch pairing: changes (conv_id, ai_turn, user_turn), the last of each answer holds; null: none.

    With ``ttl_ms`` turns are forgotten so long after they came, which bounds the state on an endless stream; turns that
    come later still are paired among themselves.
    """
    time_mode = "none" if ttl_ms is None else "processingTime"
    return turns.groupBy("conv_id").transformWithStateInPandas(Pairing(ttl_ms), "conv_id long, ai_turn long, user_turn long", "update", time_mode)


# --- sinks and drivers ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Drained:
    """What a run tells of itself: batches, rows that came too late, and rows of state it held at most and at last."""

    batches: int
    late: int
    most_state: int
    state: int


def drain(stream: DataFrame, mode: str, write) -> Drained:
    """Run a stream until its present input is used up."""
    spark = stream.sparkSession
    job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    job.awaitTermination()
    told = list(job.recentProgress)
    states = [sum(o.numRowsTotal for o in p.stateOperators) for p in told] or [0]
    late = sum(o.numRowsDroppedByWatermark for p in told for o in p.stateOperators)
    return Drained(len(told), late, max(states), states[-1])


def overwriting(path: str):
    """Complete mode: each batch is the whole result so far."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def appending(path: str, *by: str):
    """Append mode; a batch that is retried after a failure replaces its own earlier attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *by).parquet(path)

    return write


def current_rows(table: DataFrame) -> DataFrame:
    """The newest row of each key among all batches of ``upserting``, found by a maximum that starts inside the tasks."""
    columns = [c for c in table.columns if c not in ("_key", "_order", "batch_id")]
    rows = latest(table.select("_key", F.struct("_order", "batch_id").alias("_at"), *columns), ["_key"], ["_at"])
    return rows.select(*columns)


def upserting(path: str, key: str, order: list[str]):
    """Keyed last write wins: each batch adds its newest row per key under its number, readers take the newest of all.

    A batch that is retried replaces its own earlier attempt; an older change that comes late loses. Nothing is rewritten:
    merging old batches away is left to the table format that the path may be in.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, [key], order).select(*batch.columns)
        appending(path)(newest.withColumns({"_key": F.col(key), "_order": F.struct(*order)}), batch_id)

    return write


def run_daily(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    drain(daily(request_records(source(spark, folder))), "complete", overwriting(path))
    return spark.read.parquet(path)


def run_daily_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Days that are over by the watermark, each written once."""
    path = scratch(spark)
    drain(daily(request_records(source(spark, folder))), "append", appending(path))
    return spark.read.parquet(path).drop("batch_id")


def run_sessions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    drain(sessions(request_records(source(spark, folder))), "complete", overwriting(path))
    return spark.read.parquet(path)


def run_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    records = request_records(source(spark, folder))
    twice = records.union(request_records(source(spark, folder)))
    path = scratch(spark)
    drain(once(twice), "append", appending(path))
    return spark.read.parquet(path)


def run_join(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    joined = records_with_summaries(request_records(source(spark, folder)), request_summaries(source(spark, folder)))
    drain(joined, "append", appending(path))
    return spark.read.parquet(path)


def run_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append every evaluated request to the daily log."""
    path = scratch(spark)
    joined = records_with_summaries(request_records(source(spark, folder)), request_summaries(source(spark, folder)))
    entries = joined.withColumn("event_date", F.date_format("request_created_at", "yyyy-MM-dd"))
    drain(entries.select("request_id", "status", "event_date"), "append", appending(path, "event_date"))
    log = spark.read.schema("request_id string, status string, batch_id int, event_date string").parquet(path)
    return log.select("request_id", "event_date", "status")


def run_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Last request of every conversation, kept by keyed upsert."""
    path = scratch(spark)
    rows = source(spark, folder).select(F.col("user_id").cast("string").alias("conversation_id"), F.col("event_id").alias("last_event"), F.col("value").alias("latency_ms"))
    drain(rows, "append", upserting(path, "conversation_id", ["last_event"]))
    return current_rows(spark.read.parquet(path))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain_pairs(turns: DataFrame, path: str, ttl_ms: int | None = None) -> DataFrame:
    """Run the pairing over a stream of turns and read the pairs that hold in the end."""
    spark, name = turns.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # map state needs a store with column families
    try:
        drain(pairs(turns, ttl_ms), "update", appending(path))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    changes = spark.read.schema("conv_id long, ai_turn long, user_turn long, batch_id int").parquet(path)
    return latest(changes, ["conv_id", "ai_turn"], ["batch_id"]).where(F.col("user_turn").isNotNull()).select("conv_id", "user_turn", "ai_turn")


def run_pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = source(spark, folder, "conversations", TURN_SCHEMA).select("conv_id", "turn", "role")
    return drain_pairs(turns, scratch(spark))
