"""Quality rules whose cutoffs carry a guarantee: exact binomial bounds on labelled holdouts, per stratum."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import record
from corpusloom.llm.columns import covered, durable, let, spaced_words, window_keys

REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Candidate cutoffs per rule, from lax to strict, in thousandths of the rule's base. A document fails a rule when its
#: share is above the chosen cutoff.
LADDERS: dict[str, tuple[int, ...]] = {
    "symbols": (500, 300, 200, 100, 50),
    "dup_lines": (800, 600, 400),
    "repeats": (290, 250, 200, 150),
    "long_words": (20000, 15000, 12000),
}
TOLERATED = 0.02
CONFIDENCE = 0.95


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the same array; the first finding counts too."""

    def count(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        last = F.size(keys) - 1

        def starts(s: Column) -> Column:
            def again(x: Column, j: Column) -> Column:
                same_before = (j > 0) & (F.get(s, j - 1)["k"] == x["k"])
                same_after = (j < last) & (F.get(s, j + 1)["k"] == x["k"])
                return F.when(same_before | same_after, x["i"])

            return F.sort_array(F.filter(F.transform(s, again), lambda p: p.isNotNull()))

        found = let(let(placed, starts), lambda p: covered(p, REPEAT_WINDOW))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(found)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, lambda h: window_keys(h, REPEAT_WINDOW)), count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of every whole text in place of the text.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long). A null text counts as empty: all
    measures 0. Columns of those names that ``docs`` had before are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    both = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    told = let(spaced_words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    values = {
        "_w": told,
        "_l": both,
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.octet_length(t) - F.octet_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
    }
    keep = [F.col(c) for c in docs.columns if c not in {text, "n_words", "n_lines", "n_dup_lines", "n_repeat_words", *values}]
    out = docs.select(*keep, *[v.alias(n) for n, v in values.items()])
    longs = {"n_words": "_w.n", "n_lines": "_l.n", "n_dup_lines": "_l.dup", "n_repeat_words": "_w.repeat"}
    return out.withColumns({n: F.col(c).cast("long") for n, c in longs.items()}).drop("_w", "_l")


def base_failed() -> Column:
    """Too short, or too much of it repeated: judged without labels."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def exceeds(rule: str, cutoff: Column) -> Column:
    """The share of a rule is above ``cutoff`` thousandths; with an empty base it is not."""
    part, whole = {
        "symbols": ("n_symbols", "word_chars"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "long_words": ("word_chars", "n_words"),
    }[rule]
    return 1000 * F.col(part) > cutoff * F.col(whole)


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, shifted by eight so that it is exact to about 1e-12."""
    y = x.cast("double") + 9
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = sum((F.log(x + k) for k in range(2, 9)), F.log(x + 1))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact; 1 where k is at or above the mean, where no cutoff is accepted."""
    log_top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) / (n - k + 1 + j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(log_top) * F.aggregate(steps, start, down)["sum"]
    return F.when(k < n * p, F.least(tail, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(
    holdout: DataFrame,
    stratum: str,
    strata: int,
    ladders: Mapping[str, tuple[int, ...]] = LADDERS,
    tolerated: float = TOLERATED,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Per stratum and rule the strictest cutoff whose false-rejection rate is below ``tolerated``.

    ``holdout`` holds the measures of good documents only. A cutoff stands when the exact binomial probability of so
    few rejections at a rate of ``tolerated`` is at most (1 - confidence) / (rules x strata): Bonferroni over rules
    and strata, and within a ladder fixed-sequence testing from lax to strict, which stops at the first cutoff that
    fails and so needs no further correction. Together: with the stated confidence no rule in any stratum rejects more
    than ``tolerated`` of the good documents. A rule without evidence has no cutoff (null) and rejects nothing.
    """
    level = (1 - confidence) / (len(ladders) * max(strata, 1))
    steps = [(rule, i, c) for rule, ladder in ladders.items() for i, c in enumerate(ladder)]
    counts = [F.sum(exceeds(rule, F.lit(c)).cast("long")).alias(f"_{rule}_{i}") for rule, i, c in steps]
    counted = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *counts)
    each = [record(rule=F.lit(r), step=F.lit(i), cut=F.lit(c).cast("long"), failed=F.col(f"_{r}_{i}")) for r, i, c in steps]
    rows = counted.select(stratum, "n_good", F.explode(F.array(*each)).alias("t")).select(stratum, "n_good", "t.*")
    rows = rows.withColumn("holds", binomial_tail(F.col("failed"), F.col("n_good"), tolerated) <= level)
    upto = Window.partitionBy(stratum, "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("holds", F.min("holds").over(upto))
    best = [F.min(F.when((F.col("rule") == r) & F.col("holds"), F.col("cut"))).alias(f"cut_{r}") for r in ladders]
    return rows.groupBy(stratum).agg(F.first("n_good").alias("n_good"), *best)


def judged(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    ladders: Mapping[str, tuple[int, ...]] = LADDERS,
    tolerated: float = TOLERATED,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Every row of ``docs`` with its measures, base_failed, failed_rules (array) and kept; the text is left out.

    ``labels`` has ``key`` and quality; a document counts as good when it has a label and all its labels are 1. Rows
    with a null key or stratum are judged like others (null is a stratum of its own, a null key has no label). Repeated
    rows are judged one by one. Empty tables give empty results; without labels only the base rules reject.
    """
    rows = durable(measured(docs, text).withColumns({"_stratum": F.coalesce(F.col(stratum), F.lit("")), "base_failed": base_failed()}))
    good = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("_q")).where(F.col("_q") == 1)
    holdout = rows.join(good.select(key), key, "left_semi")
    strata = rows.select("_stratum").distinct().count()
    cuts = cutoffs(holdout, "_stratum", strata, ladders, tolerated, confidence)
    held = rows.join(cuts, "_stratum", "left")
    failed = F.array_compact(F.array(*[F.when(exceeds(r, F.col(f"cut_{r}")), F.lit(r)) for r in ladders]))
    out = held.withColumn("failed_rules", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_stratum", "n_good", *[f"cut_{r}" for r in ladders])
