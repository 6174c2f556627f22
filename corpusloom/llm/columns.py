"""Column expressions and small table helpers shared by the native operators of this folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.session import durable

# The six white-space characters, all of one byte, that end a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def spaced_words(text: Column) -> Column:
    """Words between white space, unchanged and in order; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(spaced_words(text)).cast("long")


def ascii_lower(word: Column) -> Column:
    """``word`` with A-Z in lower case and every other character as it was."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def window_keys(hashes: Column, length: int) -> Column:
    """One key for each ``length`` consecutive entries of an array of word hashes, in order."""
    last = F.size(hashes) - length
    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)]))
    return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def covered(starts: Column, length: int) -> Column:
    """How many positions ``length``-long windows at the ascending, distinct ``starts`` cover together."""
    last = F.size(starts) - 1
    gaps = F.transform(
        starts, lambda s, i: F.when(i < last, F.least(F.lit(length), F.get(starts, i + 1) - s)).otherwise(F.lit(length))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def global_running(df: DataFrame, order: list[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add, per name, the sum of its column over all rows that come earlier in ``order`` (which must be unique).

    Rows are dealt by range and written once; only one row per range meets in one task, so no task holds the table.
    """
    dealt = df.repartitionByRange(*order) if order else df
    dealt = durable(dealt.withColumns({"_range": F.spark_partition_id(), **{f"_v_{n}": c for n, c in sums.items()}}))
    ranges = dealt.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_r_{n}") for n in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", *[F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
    return dealt.join(starts, "_range").withColumns(added).select(*df.columns, *sums)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = [
    "SPACES", "SPACE_RUN", "ascii_lower", "covered", "durable", "global_running", "let", "spaced_words", "unused",
    "window_keys", "word_count",
]
