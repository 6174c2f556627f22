"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that ``few`` sends to the tasks of a join.
FEW = 1 << 16
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir`` for intermediate tables.

    Only a session on one machine may leave it unset and then gets a temporary folder of its own; on a cluster executors
    could not see each other's files there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used where several branches of a plan need the same costly rows: they are computed once, survive the loss of
    executors, and come back with sizes that adaptive execution can trust.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, what a query shuffles is freed when it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREES)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES, before)


def few(df: DataFrame) -> DataFrame:
    """``durable`` rows without texts that are to meet a large table: up to ``FEW`` of them go to it by a broadcast."""
    written = durable(df)
    return F.broadcast(written) if written.count() <= FEW else written
