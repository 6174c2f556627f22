"""Importance resampling: the model against plain counting, the sample against sorting, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import importance
from corpusloom.llm.bytewords import words

FOLDER = "/root/testdata/sf0.001"


def corpus(spark, n: int = 1200):
    draw = random.Random(3)
    clean, junk = [f"good{i}" for i in range(60)], [f"!!{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        pick = [draw.choice(junk if bad and draw.random() < 0.4 else clean) for _ in range(draw.randrange(20, 80))]
        rows.append((i, " ".join(pick)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[1][1]), (1, rows[1][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_sample_is_accurate(spark):
    docs, labels, n = corpus(spark)
    rows = importance.weighed(docs, labels).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    clean, junk = {i for i in range(n) if i % 6}, {i for i in range(n) if i % 6 == 0}
    assert len(clean - kept) <= 0.05 * len(clean) and len(junk & kept) <= 0.02 * len(junk)
    assert not kept & {n, n + 1, n + 2} and len(rows) == docs.count()
    out = importance.resampled(docs.withColumn("_word", F.lit(1)), labels)
    assert out.columns == ["doc_id", "text", "_word"] and {r["doc_id"] for r in out.collect()} == kept


def test_without_labels(spark):
    docs, labels, _ = corpus(spark, 40)
    assert importance.resampled(docs, labels.limit(0)).count() == docs.count()
    assert all(r["kept"] for r in importance.weighed(docs, labels.limit(0)).collect())
    assert importance.weighed(docs.limit(0), labels).count() == 0


def test_counts_and_scores(spark):
    docs, _, _ = corpus(spark, 60)
    rows = docs.select("text", (F.col("doc_id") % 3 == 0).alias("target"))
    listed = rows.collect()
    total = (1 << importance.WORD_BITS) + (1 << importance.PAIR_BITS)
    raw, target = np.zeros(total), np.zeros(total)
    for r in listed:
        word, _, pair, _ = importance._grams(words(pa.array([r["text"]])))
        for bucket in [*word, *(pair + (1 << importance.WORD_BITS))]:
            raw[bucket] += 1
            target[bucket] += bool(r["target"])
    got = {r["bucket"]: (r["raw"], r["target"]) for r in importance.gram_counts(rows).collect()}
    assert got == {i: (raw[i], target[i]) for i in np.flatnonzero(raw)}


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    draw = random.Random(k)
    values = [draw.choice([draw.gauss(0, 1), 0.5, -1e6]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert importance.kth_largest(df, "v", k, most=10, bins=8) == sorted(values, reverse=True)[k - 1]


def test_long_clean_texts_stay(spark):
    """Clean texts hold a junk word now and then, some languages more often; length alone must not speak against one."""
    draw = random.Random(5)
    clean, junk = [f"good{i}" for i in range(300)], [f"!!{i}" for i in range(20)]

    def text(size, share):
        return " ".join(draw.choice(junk if draw.random() < share else clean) for _ in range(size))

    rows, labels = [], []
    for i in range(3000):
        bad = i % 6 == 0
        rows.append((i, text(draw.randrange(20, 200), 0.4 if bad else 0.002 if i % 2 else 0.005)))
        if i % 4 < 2:
            labels.append((i, int(not bad), 0))
    good = [t for i, t in rows if i % 6]
    long_clean, long_junk = [5_000, 20_000, 50_000, 200_000], [5_000, 20_000]
    for i, size in enumerate(long_clean):
        joined = " ".join(draw.choice(good) for _ in range(size // 100))
        rows.append((10_000 + i, joined))
    rows += [(20_000 + i, text(size, 0.1)) for i, size in enumerate(long_junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in importance.weighed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() if r["kept"]}
    assert [i for i in range(len(long_clean)) if 10_000 + i not in kept] == []
    assert not kept & {20_000 + i for i in range(len(long_junk))}
    ordinary = {i for i in range(3000) if i % 6}
    assert len(ordinary - kept) <= 0.05 * len(ordinary) and len(kept & {i for i in range(0, 3000, 6)}) <= 10
