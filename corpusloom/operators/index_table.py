"""A term and vector index that follows its corpus: changed parents replace their chunks, statistics move by differences.

Plain Parquet. ``forward`` holds one row per chunk with its term counts and vector, partitioned by a hash of the parent and
by batch. A change adds the chunks that come and a mark for each parent that goes, and rewrites nothing: a parent's chunks
and marks put its chunks of earlier batches out of sight, until ``settle`` leaves these out. ``terms`` and ``sizes`` hold, for each
batch of changes, by how much document frequencies, the number of chunks and their lengths went up or down; sums over all
batches are the statistics, and ``compact`` adds the batches up. ``order`` numbers the batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import STOP_WORDS, terms
from corpusloom.operators import sparse
from corpusloom.session import durable, shuffles_freed

#: Partitions of the forward table; a parameter of an index that must stay the same.
BUCKETS = 64
#: Tasks that share the rows of a bucket, at most, when these are written.
SPREAD = 8
#: Up to so many parents go to the chunks by a broadcast; beyond it both are shuffled.
BROADCAST = 1 << 20
_CHANGES = {"terms": "term string, df long", "sizes": "n long, length long"}


@dataclass(frozen=True)
class IndexTable:
    """Where an index lies, its number of buckets, and the columns it keeps beside ids and counts, as DDL."""

    path: str
    keep: str = ""
    buckets: int = BUCKETS
    id_type: str = "string"
    stop_words: Sequence[str] = tuple(STOP_WORDS)

    @property
    def schema(self) -> T.StructType:
        kept = f", {self.keep}" if self.keep else ""
        return T.StructType.fromDDL(f"child_id {self.id_type}, parent_id {self.id_type}, dl int, counts array<struct<term:string,tf:int>>{kept}, bucket int")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("parent_id"), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The chunks and marks of all batches."""
        fields = [f for f in self.schema.fields if f.name != "bucket"]
        schema = T.StructType(fields + T.StructType.fromDDL("seq long, bucket int, batch string, mark int").fields)
        return spark.read.schema(schema).parquet(f"{self.path}/forward")

    def stored(self, spark: SparkSession, marks: bool) -> DataFrame:
        """The chunks of all batches, or the marks."""
        return self.rows(spark).where(F.col("mark") == int(marks))

    def forward(self, spark: SparkSession, of: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """One row per chunk that no later batch has replaced or deleted; ``of`` are the distinct parents wanted, ``before``
        shows the index as it was before the batch of that number."""
        earlier = F.lit(True) if before is None else F.col("seq") < before
        rows = self.stored(spark, False).where(F.col("child_id").isNotNull() & earlier)
        if of is not None:  # first, so that only their chunks meet the marks
            rows = rows.join(_beside(of.select("parent_id"), of.count()), "parent_id", "left_semi")
        last = durable(self.touched(spark).where(earlier).groupBy(F.col("parent_id").alias("_parent")).agg(F.max("seq").alias("_seq")))
        out = (F.col("parent_id") == F.col("_parent")) & (F.col("seq") < F.col("_seq"))
        return rows.join(_beside(last, last.count()), out, "left_anti").select(*self.schema.names)

    def touched(self, spark: SparkSession) -> DataFrame:
        """(parent_id, seq) of the parents that changes replaced or deleted, as often as they have chunks or marks."""
        rows = self.rows(spark).where((F.col("seq") > 0) & F.col("parent_id").isNotNull())
        return rows.select("parent_id", "seq")

    def changes(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.schema(f"{_CHANGES[kind]}, batch string").parquet(f"{self.path}/{kind}")


def _beside(parents: DataFrame, count: int) -> DataFrame:
    """Parents that are to meet chunks, which are many more and wide: these are not sorted, and not moved for few parents."""
    return F.broadcast(parents) if count <= BROADCAST else parents.hint("shuffle_hash")


def _overwrite(rows: DataFrame, path: str, *by: str, whole: bool = False) -> None:
    """Replace exactly the partitions that occur in ``rows``, or the ``whole`` table."""
    mode = "static" if whole else "dynamic"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def deal(index: IndexTable, rows: DataFrame) -> DataFrame:
    """Rows with a parent_id dealt as the index lies; a bucket may be the work of several tasks.

    Parents dealt before they are cut and embedded move as texts, several times smaller than the rows of the index.
    """
    return rows.repartition(index.bucket(), F.pmod(F.hash("parent_id"), F.lit(SPREAD)))


def _add(index: IndexTable, rows: DataFrame, batch: str, whole: bool = False) -> None:
    """Write dealt rows (chunks, ``seq``, ``mark``) under the name of a batch."""
    _overwrite(rows.withColumn("batch", F.lit(batch)), f"{index.path}/forward", "bucket", "batch", "mark", whole=whole)


def _chunks(index: IndexTable, children: DataFrame) -> DataFrame:
    """Children as rows of the forward table. Those without a term have a vector but no counts."""
    kept = [f.name for f in index.schema.fields if f.name not in ("child_id", "parent_id", "dl", "counts", "bucket")]
    rows = children.select("child_id", "parent_id", *kept, terms(F.col("text"), index.stop_words).alias("tokens"))
    rows = rows.withColumns({"dl": F.size("tokens"), "counts": sparse.counted(F.col("tokens")), "bucket": index.bucket()})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in index.schema.fields])


def _difference(new: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """By how much ``terms`` and ``sizes`` change when ``new`` chunks come and ``old`` ones go. Sums start inside the tasks."""
    rows = new.select("counts", "dl", F.lit(1).alias("sign"))
    if old is not None:
        rows = rows.unionByName(old.select("counts", "dl", F.lit(-1).alias("sign")))
    each = rows.select("sign", F.explode("counts.term").alias("term"))
    frequencies = each.groupBy("term").agg(F.sum("sign").alias("df")).where(F.col("df") != 0)
    indexed = rows.where(F.col("dl") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return frequencies, indexed.agg(total(F.col("sign")).alias("n"), total(F.col("sign") * F.col("dl")).alias("length"))


def create(index: IndexTable, children: DataFrame, *, dealt: bool = False) -> None:
    """Write the index of ``children`` (child_id, parent_id, text, and the columns to keep), in place of any other there.

    ``dealt`` tells that ``children`` were made of parents that went through ``deal``.
    """
    spark = children.sparkSession
    with shuffles_freed(spark):
        rows = _chunks(index, children if dealt else deal(index, children))
        _add(index, rows.withColumns({"seq": F.lit(0).cast("long"), "mark": F.lit(0)}), "0", whole=True)
        _overwrite(spark.createDataFrame([(0, "0")], "seq long, batch string"), f"{index.path}/order", "batch", whole=True)
        _record(index, "0", *_difference(index.stored(spark, False).where(F.col("child_id").isNotNull()), None), whole=True)


def _number(index: IndexTable, spark: SparkSession, batch: str) -> int:
    """The place of a batch in the order of batches, the next one for a new name."""
    order = spark.read.schema("seq long, batch string").parquet(f"{index.path}/order")
    found = order.agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))).alias("own"), F.max("seq").alias("last")).first()
    if found["own"] is not None:
        return found["own"]
    _overwrite(spark.createDataFrame([(found["last"] + 1, batch)], "seq long, batch string"), f"{index.path}/order", "batch")
    return found["last"] + 1


def _record(index: IndexTable, batch: str, frequencies: DataFrame, sizes: DataFrame, whole: bool = False) -> None:
    """Differences of a batch under its name; ``sizes``, written last, tells that they are whole."""
    for kind, rows in (("terms", frequencies), ("sizes", sizes)):
        _overwrite(rows.withColumn("batch", F.lit(batch)), f"{index.path}/{kind}", "batch", whole=whole)


def change(
    index: IndexTable, batch: str, children: DataFrame | None = None, deleted: DataFrame | None = None, *,
    spark: SparkSession | None = None, dealt: bool = False,
) -> None:
    """Replace the chunks of every parent in ``children`` by those given, and drop those of the parents in ``deleted``.

    ``children`` holds all chunks of its parents (``dealt`` as in ``create``); ``deleted`` has a column parent_id; a parent
    in both is replaced. Unknown parents are simply new, or nothing to delete. Only the buckets of these parents get files,
    and no file is rewritten.

    Chunks are made once, as they are written; differences are taken from what was written and from the index as it was
    before. A batch that broke off is repeated under the same name: its rows take the place of those it wrote, and its
    differences, once whole, are not taken again. Between both steps searches see new chunks under old statistics.
    """
    spark = spark or (children if children is not None else deleted).sparkSession
    with shuffles_freed(spark):
        new = spark.createDataFrame([], index.schema) if children is None else _chunks(index, children if dealt else deal(index, children))
        rows = new.withColumn("mark", F.lit(0))
        if deleted is not None:
            gone = deal(index, deleted.select("parent_id").where(F.col("parent_id").isNotNull()).distinct()).withColumn("bucket", index.bucket())
            marks = gone.select(*[F.col(f.name) if f.name in gone.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields])
            rows = rows.unionByName(marks.withColumn("mark", F.lit(1)))
        seq = _number(index, spark, batch)
        _add(index, rows.withColumn("seq", F.lit(seq).cast("long")), batch)
        if index.changes(spark, "sizes").where(F.col("batch") == batch).isEmpty():
            parents = durable(index.touched(spark).where(F.col("seq") == seq).select("parent_id").distinct())
            new = index.stored(spark, False).where(F.col("seq") == seq)
            _record(index, batch, *_difference(new, index.forward(spark, parents, before=seq)))


def settle(index: IndexTable, spark: SparkSession) -> None:
    """Write ``forward`` anew without marks and without what they put out of sight. No search or change may run meanwhile."""
    with shuffles_freed(spark):
        live = durable(index.forward(spark))
        _add(index, deal(index, live).withColumns({"seq": F.lit(0).cast("long"), "mark": F.lit(0)}), "0", whole=True)


def compact(index: IndexTable, spark: SparkSession, batches: Sequence[str], into: str) -> None:
    """Add up the differences of some batches under one of their names; the others' become empty."""
    for kind, key in (("terms", ["term"]), ("sizes", [])):
        some = index.changes(spark, kind).where(F.col("batch").isin(list(batches)))
        values = [c for c in some.columns if c not in (*key, "batch")]
        total = durable(some.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in values]).withColumn("batch", F.lit(into)))
        names = spark.createDataFrame([(b,) for b in batches if b != into], "batch string")
        nothing = names.select(*[F.lit(None).cast("string").alias(c) for c in key], *[F.lit(0).cast("long").alias(c) for c in values], "batch")
        _overwrite(total.unionByName(nothing), f"{index.path}/{kind}", "batch")


def searchable(index: IndexTable, spark: SparkSession, variant: str = "lucene") -> sparse.SparseIndex:
    """The stored index for ``sparse.bm25``.

    A term's largest weight is not stored, as it cannot be followed when chunks go; the limit of its formula stands for
    it, so pruned search gives the same rows and skips less.
    """
    k1, _, delta = sparse.VARIANTS[variant]
    limit = 1.0 if variant == "lucene" else delta + k1 + 1
    sizes = index.changes(spark, "sizes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("length").alias("length"))
    corpus = sizes.select("n", F.try_divide("length", "n").alias("avgdl"))
    frequencies = index.changes(spark, "terms").where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    term_stats = frequencies.where(F.col("df") > 0).select("term", "df", F.lit(limit).alias("top_weight"))
    forward = index.forward(spark).where(F.col("dl") > 0).drop("bucket")
    hits = forward.select("child_id", *[c for c in forward.columns if c not in ("child_id", "counts")], F.explode("counts").alias("c"))
    postings = hits.select(F.col("c.term").alias("term"), "child_id", *[c for c in forward.columns if c not in ("child_id", "counts", "dl")], F.col("c.tf").alias("tf"), "dl")
    return sparse.SparseIndex(forward, postings, term_stats, corpus, "child_id")
