"""Readers and writers of the engine's tables: explicit schemas, partitioned writes, no inference."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"


def read_texts(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Every file below a folder as one row (path, text, text_length, last_modified); files are never split."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(folder, wholetext=True)
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.length("value").alias("text_length"),
        F.col("_metadata.file_modification_time").alias("last_modified"), F.lit("TextLoader").alias("document_loader"),
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, sizes and times of the files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("last_modified"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines and a leading byte-order mark are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).where(F.col("line") != "")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Seed rows from JSON lines, a JSON list, or an object with a ``samples`` list."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    whole = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_inline(schema)}>>")).otherwise(
        F.from_json("v", f"struct<samples:array<struct<{_inline(schema)}>>>")["samples"]
    )
    return whole.select(F.explode(listed).alias("r")).select("r.*")


def _inline(schema: str) -> str:
    from pyspark.sql import types as T

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_dataset(samples: DataFrame, manifest: DataFrame, sheet: DataFrame, root: str, category: str, name: str, version: str) -> str:
    """Samples, manifest and review sheet of a dataset version under ``category/name/version``."""
    path = f"{root.rstrip('/')}/category={category}/name={name}/version={version}"
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    write_jsonl(manifest, f"{path}/manifest")
    sheet.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/review_sheet")
    return path


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, manifest) of a dataset version."""
    return spark.read.parquet(f"{path}/samples"), spark.read.json(f"{path}/manifest")


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    columns = ("sample_id", "review_status", "review_notes", "difficulty_level", "scenario_type", "user_input", "reference_answer", "scope_file_ids", "reference_doc_ids", "tags")
    schema = ", ".join(f"{c} string" for c in columns)
    reader = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.csv(path)


def write_run(records: DataFrame, meta: DataFrame, root: str, run_id: str) -> str:
    """Records and one row of settings of a run."""
    path = f"{root.rstrip('/')}/run_id={run_id}"
    records.write.mode("overwrite").parquet(f"{path}/records")
    write_jsonl(meta, f"{path}/run_meta")
    return path


# What an old run record lacks and gets on read.
RUN_DEFAULTS = {
    "query_type": "unknown", "hop_count": "unknown", "abstraction_level": "unknown", "evidence_topology": "unknown",
    "query_type_source": "unknown", "difficulty_level": "unknown", "scenario_type": "general", "source_type": "manual",
    "review_status": "pending", "status": "success", "actual_response": "",
}
RUN_LISTS = ("actual_doc_ids", "actual_file_ids", "actual_contexts", "reference_doc_ids", "reference_contexts", "scope_file_ids", "capabilities", "tags")


def with_run_defaults(records: DataFrame) -> DataFrame:
    """Records of any age with every column: stated defaults for texts, empty lists for lists; ids ordered and unique."""
    out = {}
    have = set(records.columns)
    for name, default in RUN_DEFAULTS.items():
        out[name] = F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    none = F.array().cast("array<string>")
    for name in RUN_LISTS:
        values = F.coalesce(F.col(name), none) if name in have else none
        out[name] = F.array_distinct(values) if name.endswith("_ids") else values
    return records.withColumns(out)


def write_scores_csv(parts: Sequence[DataFrame], path: str) -> list[str]:
    """Score tables of different columns in one sheet; the header is their union in first-seen order."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return rows.columns


def write_daily(entries: DataFrame, path: str) -> None:
    """Append log entries under their event date."""
    entries.write.mode("append").partitionBy("event_date").parquet(path)


def read_day(spark: SparkSession, path: str, schema: str, event_date: str) -> DataFrame:
    """One day of the log; other days' files are not touched, a missing day is empty."""
    rows = spark.read.schema(f"{schema}, event_date string").parquet(path)
    return rows.where(F.col("event_date") == event_date).drop("event_date")


def overwrite_days(entries: DataFrame, path: str) -> None:
    """Replace exactly the days that occur in ``entries``."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def publish(staged: dict[str, DataFrame], root: str, version: str) -> dict[str, str]:
    """Write all tables of an ingest under one new version; readers switch when the last table is complete.

    A failed write leaves an unpublished version behind and the published tables unchanged.
    """
    paths = {name: f"{root.rstrip('/')}/version={version}/{name}" for name in staged}
    for name, df in staged.items():
        df.write.mode("errorifexists").parquet(paths[name])
    spark = next(iter(staged.values())).sparkSession
    folder = f"{root.rstrip('/')}/published"
    try:
        last = spark.read.schema(POINTER).parquet(folder).agg(F.max("number")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    spark.createDataFrame([(version, last + 1)], POINTER).write.mode("append").parquet(folder)
    return paths


#: Which version was published when, by a number that grows with each; no clock is asked.
POINTER = "version string, number long"


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the version published last. Publishing adds one pointer and removes none, so there is always one.

    Two drivers that publish at the same moment may take the same number; of those the larger version counts.
    """
    pointers = spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/published")
    version = pointers.agg(F.max_by("version", F.struct("number", "version"))).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}/{name}")
