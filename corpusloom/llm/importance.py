"""Quality by importance resampling: hashed n-gram models of target and raw text, their ratio, and a Gumbel top-k draw."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.llm.bytewords import Words, mixed, slices, words
from corpusloom.llm.columns import durable, unused

#: Buckets of the two models, as powers of two: words, and pairs of neighbouring words.
WORD_BITS, PAIR_BITS = 18, 16
#: Most labelled target documents that are used; half of them fit the target model, half set the size of the sample.
MOST_LABELLED = 20_000
#: Share of held-out target documents that may fall below the sample's level, by words and by pairs each.
MISSED = 0.005
#: A word, or a pair, counts against a text when the target model finds it this much rarer than the raw model (natural log).
RARER = (1.4, 1.0)
#: How many times the level's distance from zero is larger than the scale of the Gumbel noise.
SHARPNESS = 50.0
SEED = "resample"
_SLICE = 2_000_000


@dataclass(frozen=True)
class Ratio:
    """log p_target / p_raw per bucket where it is below -RARER, else 0."""

    word: np.ndarray
    pair: np.ndarray


def _grams(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every word and of every pair of neighbours."""
    owner = found.owner()
    word = (mixed(found.hash, 1) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        both = mixed(found.hash[:-1] * np.uint64(3) + mixed(found.hash[1:], 2), 3)
    pair = (both >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    return word, owner, pair[same], owner[:-1][same]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all of ``rows`` (text, target boolean); pair buckets come after the word buckets.

    A task adds up its own texts and emits at most one row per bucket.
    """
    total = (1 << WORD_BITS) + (1 << PAIR_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            size = np.diff(_offsets(batch["text"]))
            chosen = batch["target"].fill_null(False).to_numpy(zero_copy_only=False)
            for low, high in slices(size, _SLICE):
                word, of_word, pair, of_pair = _grams(words(batch["text"][low:high]))
                picked = chosen[low:high]
                raw += np.bincount(word, minlength=total) + np.bincount(pair + (1 << WORD_BITS), minlength=total)
                if picked.any():
                    target += np.bincount(word[picked[of_word]], minlength=total)
                    target += np.bincount(pair[picked[of_pair]] + (1 << WORD_BITS), minlength=total)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": target[at]})

    counted = rows.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _offsets(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string())
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def fitted(counts: DataFrame, rarer: tuple[float, float] = RARER) -> Ratio:
    """The two models' ratios. The counts that come to the driver are one row per bucket, 2^18 + 2^16 at most.

    Each count is smoothed by one: a bucket's ratio is what the target holds of it, plus one, over what the raw model
    expects in as much text, plus one. So buckets too rare to tell do not count, in corpora of any size.
    """
    table = counts.toArrow()
    both = np.zeros((2, (1 << WORD_BITS) + (1 << PAIR_BITS)))
    at = table["bucket"].to_numpy()
    both[0, at], both[1, at] = table["raw"].to_numpy(), table["target"].to_numpy()
    out = []
    for (raw, target), least in zip((both[:, : 1 << WORD_BITS], both[:, 1 << WORD_BITS :]), rarer, strict=True):
        ratio = np.log((target + 1) / (raw * (target.sum() / max(raw.sum(), 1)) + 1))
        out.append(np.where(ratio < -least, ratio, 0).astype(np.float32))
    return Ratio(*out)


def scored(docs: DataFrame, ratio: Ratio, text: str, word_sum: str, n_words: str, pair_score: str) -> DataFrame:
    """``docs`` with what the words say against the text, their number, and what its pairs say per pair (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in (word_sum, n_words, pair_score)]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for low, high in slices(np.diff(_offsets(texts)), _SLICE):
                word, of_word, pair, of_pair = _grams(words(texts[low:high]))
                n = high - low
                number = np.bincount(of_word, minlength=n)
                sums = np.bincount(of_word, model.word[word], n)
                per_pair = np.bincount(of_pair, model.pair[pair], n) / np.maximum(np.bincount(of_pair, minlength=n), 1)
                told = [pa.array(c.astype(np.float64), mask=number == 0) for c in (sums, number, per_pair)]
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=[*part.schema.names, word_sum, n_words, pair_score])

    return docs.mapInArrow(score, schema)


@dataclass(frozen=True)
class Length:
    """What clean text of n words is expected to score: ``mean`` times n, with a variance in proportion to n + spread n^2."""

    mean: float
    spread: float


def expected(held: DataFrame, word_sum: str, n_words: str) -> Length | None:
    """The expectation of the held-out target documents; nothing where they hold no word.

    The variance has a part that grows with n (single words) and one that grows with n^2 (texts differ in their mean, as
    languages do). The second is the slope of the squared deviation per word over n; it is at least what makes a text
    longer than all of these no surer than the longest. Sums are decimals, so that any order of rows gives the same.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    total, n = F.col(word_sum), F.col(n_words)
    rows, words_, longest, squares, against = held.where(n > 0).agg(F.count(n), exact(n), F.max(n), exact(n * n), exact(total)).first()
    if not rows:
        return None
    mean = against / words_
    off = (total - F.lit(mean) * n) ** 2
    off_words, off_all = held.where(n > 0).agg(exact(off / n), exact(off)).first()
    varied = squares / rows - (words_ / rows) ** 2
    slope = (off_all / rows - off_words / rows * words_ / rows) / varied if varied > 0 else 0.0
    single = off_all / words_
    return Length(mean, max(slope / single if single > 0 else 0.0, 1 / longest))


def word_score(word_sum: Column, n_words: Column, length: Length) -> Column:
    """What the words say against a text beyond what clean text of its length is expected to, in its spread; 0 at best."""
    beyond = word_sum - F.lit(length.mean) * n_words
    return F.least(beyond / F.sqrt(n_words + F.lit(length.spread) * n_words * n_words), F.when(n_words > 0, 0.0))


def log_weight(word_score: Column, pair_score: Column, levels: tuple[float, float], sharpness: float = SHARPNESS) -> Column:
    """The log importance weight: 0 for a text with nothing against it, -sharpness at a level; the worse model decides."""
    worst = F.least(word_score / abs(levels[0]), pair_score / abs(levels[1]))
    return F.coalesce(F.lit(sharpness) * worst, F.lit(-1e6))


def gumbel(seed: str, *parts: Column) -> Column:
    """Gumbel noise from a hash of the row, so that reruns draw alike."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(rows: DataFrame, column: str, k: int, most: int = 10_000, bins: int = 1024) -> float:
    """The exact k-th largest value: counts per bin narrow the range until at most ``most`` values are left to look at."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    value = F.col(column)
    while low < high:
        inside = rows.where((value >= low) & (value <= high))
        bin_of = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
        found = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        above = rows.where(value > high).count()
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] <= most:
            values = inside.where((value >= r["low"]) & (value <= r["high"])).select(column).collect()
            return sorted((v[0] for v in values), reverse=True)[k - above - 1]
        low, high = r["low"], r["high"]
    return low


@dataclass(frozen=True)
class Sampler:
    """What a fitted resampler decides by: model, expected score, levels, and the key from which on a row is in the sample."""

    ratio: Ratio
    length: Length
    levels: tuple[float, float]
    cut: float


def target_ids(labels: DataFrame, key: str, most: int) -> DataFrame:
    """(key, fold): at most ``most`` labelled documents of good quality and not toxic, in hashed order; fold 0 or 1."""
    each = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    good = each.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    order = F.xxhash64(F.lit(SEED), "_key")
    return good.orderBy(order, "_key").limit(most).select("_key", F.pmod(F.shiftright(order, 7), F.lit(2)).alias("_fold"))


def _narrow(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    ids = F.broadcast(target_ids(labels, key, most))  # at most ``most`` rows
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
    return rows.join(ids, rows["_id"] == ids["_key"], "left").select("_id", "text", "_fold")


def sampler(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED, missed: float = MISSED) -> tuple[Sampler | None, DataFrame]:
    """The fitted resampler and its table (key, fold, scores, log weight, Gumbel key) over all documents.

    Raw counts are those of all of ``docs``. The sample's size k is the number of documents at or above the level that
    all but ``missed`` of the held-out target documents reach. Without usable labels there is no sampler.
    """
    rows = _narrow(docs, labels, key, text, most_labelled)
    ratio = fitted(gram_counts(rows.withColumn("target", F.col("_fold") == 0)))
    noisy = rows.withColumn("_gumbel", gumbel(SEED, F.col("_id"), F.col("text")))
    told = durable(scored(noisy, ratio, "text", "_sum", "_n", "_pair").drop("text"))
    length = expected(told.where(F.col("_fold") == 1), "_sum", "_n")
    if length is None:
        return None, told
    told = told.withColumn("_word", word_score(F.col("_sum"), F.col("_n"), length))
    held = told.where(F.col("_fold") == 1).agg(*[F.percentile(c, missed) for c in ("_word", "_pair")]).first()
    levels = tuple(min(x, -1e-6) for x in held)
    keyed = durable(told.withColumn("_weight", log_weight(F.col("_word"), F.col("_pair"), levels)).withColumn("_sort", F.col("_weight") + F.col("_gumbel")))
    k = keyed.where(F.col("_weight") >= -SHARPNESS).count()
    cut = kth_largest(keyed, "_sort", k) if k else float("inf")
    return Sampler(ratio, length, levels, cut), keyed


def weighed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, log_weight, kept) for every row of ``docs``. See ``resampled``."""
    found, rows = sampler(docs, labels, key, text, **options)
    if found is None:
        return rows.select(F.col("_id").alias(key), F.lit(None).cast("double").alias("log_weight"), F.lit(True).alias("kept"))
    return rows.select(F.col("_id").alias(key), F.col("_weight").alias("log_weight"), (F.col("_sort") >= found.cut).alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in the Gumbel top-k sample, with its columns.

    Texts without a word (null, empty, blank) have the lowest weight. Rows alike in key and text draw alike; where such
    rows tie at the cut all of them stay. A null key has no label. Empty tables give empty results, and without labelled
    target documents every row stays.
    """
    found, _ = sampler(docs, labels, key, text, **options)
    if found is None:
        return docs
    total, n, pair, noise = (unused(docs, c) for c in ("_sum", "_n", "_pair", "_gumbel"))
    rows = docs.withColumn(noise, gumbel(SEED, F.col(key), F.col(text)))
    rows = scored(rows, found.ratio, text, total, n, pair)
    word = word_score(F.col(total), F.col(n), found.length)
    return rows.where(log_weight(word, F.col(pair), found.levels) + F.col(noise) >= found.cut).select(*docs.columns)
