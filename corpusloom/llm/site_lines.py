"""Boilerplate lines by site: how large a part of a host's pages holds the same line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import SPACES, durable, let, unused

MOST_SHARE = 0.1
LEAST_PAGES = 3


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line without the white space at its ends; null for a line without a word."""
    trimmed = F.btrim(line, F.lit(SPACES))
    return F.when(trimmed != "", F.unhex(F.md5(trimmed.cast("binary"))))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, keys): for each host the keys of the lines on more than ``most_share`` of its pages and on ``least_pages``.

    A line counts once per page. Pages without a text count as pages. Tasks add up their own pages first, so a line that
    is on every page of a hot host moves as one row per task. A host's lines above a share s number at most its mean
    distinct lines per page / s, so the array is as short as a few pages.
    """
    pages = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    keys = F.array_distinct(F.transform(F.split("_text", "\n"), _line_key))
    lines = pages.select("_host", F.explode(F.array_compact(keys)).alias("_line"))
    counted = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_pages)
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    both = counted.join(totals, counted["_host"].eqNullSafe(totals["_host"])).select(counted["_host"], "_line", "_n", "_pages")
    over = both.where(F.col("_n") > most_share * F.col("_pages"))
    return over.groupBy("_host").agg(F.collect_list("_line").alias("_lines"))


def without_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """``docs`` with the text without boilerplate lines, and the numbers of lines before and dropped (long).

    Lines are split at \\n and compared without white space at their ends; the lines that stay keep theirs. Lines without
    a word are never dropped. A null text stays null with 0 lines; an empty one is one line. A null host is a host of
    its own. Repeated rows are pages of their own. Columns called like the two counts are replaced.
    """
    found = durable(boilerplate(docs, host, text, most_share, least_pages))  # of known size: small ones are broadcast
    bad = unused(docs, "_bad")
    right = found.select(F.col("_host").alias(unused(docs, "_h")), F.col("_lines").alias(bad))
    rows = docs.join(right, docs[host].eqNullSafe(right[right.columns[0]]), "left")
    lines = F.split(F.col(text), "\n")
    stays = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col(bad), _line_key(line)), F.lit(False)))
    told = let(lines, lambda a: F.struct(F.size(a).alias("n"), stays.alias("stays")))
    told = F.when(F.col(bad).isNull(), F.struct(F.size(lines).alias("n"), lines.alias("stays"))).otherwise(told)
    t = unused(docs, "_told")
    rows = rows.withColumn(t, told)
    n, left = F.col(f"{t}.n"), F.size(f"{t}.stays")
    new = {
        text: F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(F.col(f"{t}.stays"), "\n")),
        n_lines: F.when(F.col(text).isNull(), 0).otherwise(n).cast("long"),
        n_dropped: F.when(F.col(text).isNull(), 0).otherwise(n - left).cast("long"),
    }
    keep = [c for c in docs.columns if c not in (n_lines, n_dropped, text)]
    made = rows.select(*keep, *[c.alias(name) for name, c in new.items()])
    return made.select(*[c for c in docs.columns if c not in (n_lines, n_dropped)], n_lines, n_dropped)
