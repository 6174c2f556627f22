"""What a query may see: scopes of several files, which may overlap, and metadata filters, both as bits of a row.

A scope is a bitmap over file numbers, one bit a file, so that a scope of a million files is 125 KB and goes to the hits
instead of the hits to it. A filter is evaluated once for each chunk, whatever the number of queries that use it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.filters import metadata_filter
from corpusloom.session import durable

MOST_FILTERS = 62
BROADCAST_BITMAPS = 4096


@dataclass(frozen=True)
class Scopes:
    """``members``: (scope_id, file_id, file_no), each once; ``bits``: (scope_id, bucket, bits), a bitmap for each
    32,768 file numbers of which the scope holds any."""

    members: DataFrame
    bits: DataFrame

    def files(self) -> DataFrame:
        return self.members.select("file_id", "file_no").distinct()


def numbered(values: DataFrame, column: str, number: str) -> DataFrame:
    """Each distinct value of a column that is not null, with a number from 1 in ascending order, without gaps.

    Values are dealt by range and sorted there; only one row per range meets in one task.
    """
    dealt = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    dealt = durable(dealt.withColumn("_at", F.monotonically_increasing_id()))  # range, then place in it
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(starts, "_range").select(column, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(number))


def scope_bits(scopes: DataFrame) -> Scopes:
    """(scope_id, file_id) rows as bitmaps. Rows with a null are no members."""
    rows = scopes.select("scope_id", "file_id").where(F.col("scope_id").isNotNull()).distinct()
    members = durable(rows.join(numbered(rows, "file_id", "file_no"), "file_id").select("scope_id", "file_id", "file_no"))
    bucket = F.bitmap_bucket_number("file_no").alias("bucket")
    bits = members.groupBy("scope_id", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_no")).alias("bits"))
    return Scopes(members, durable(bits))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` holds a position."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position.cast("int").bitwiseAND(F.lit(7))) == 1


def in_scopes(rows: DataFrame, scopes: Scopes, scope: str = "scope_id", file_no: str = "file_no") -> DataFrame:
    """Rows whose file is in their scope.

    The bitmaps are a written table: up to ``BROADCAST_BITMAPS`` (4 KB each) they are broadcast, beyond that Spark decides,
    and may shuffle the rows by scope and bucket.
    """
    few = scopes.bits.count() <= BROADCAST_BITMAPS
    right = (F.broadcast(scopes.bits) if few else scopes.bits).select(F.col("scope_id").alias("_scope"), F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    same = (rows[scope] == F.col("_scope")) & (F.bitmap_bucket_number(rows[file_no]) == F.col("_bucket"))
    found = rows.join(right, same).where(has_bit(F.col("_bits"), F.bitmap_bit_position(F.col(file_no))))
    return found.select(*rows.columns)


def filter_bits(filters: Mapping[str, Mapping[str, Any]], resolve=F.col) -> Column:
    """One number per row: bit 0 is always set, bit i + 1 where the i-th filter holds. Unknown counts as no."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters at once")
    bits = F.lit(1).cast("long")
    for i, conditions in enumerate(filters.values()):
        bits = bits + F.when(metadata_filter(conditions, resolve), F.lit(1 << (i + 1)).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def filter_number(filters: Mapping[str, Mapping[str, Any]], name: Column) -> Column:
    """The bit of the named filter; 0 for no name. An unknown name is an error: it must not show everything."""
    number = F.when(name.isNull(), 0)
    for i, known in enumerate(filters):
        number = number.when(name == known, i + 1)
    return number.otherwise(F.raise_error(F.concat(F.lit("unknown filter: "), name)).cast("int"))


def passes(bits: Column, number: Column) -> Column:
    return F.getbit(bits, number) == 1
