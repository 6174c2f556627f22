"""Edit-aware counts against counting the edited text anew."""

import random

import pytest

from corpusloom.llm.edit_tokens import CountedText, counted, counter
from corpusloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def count():
    return counter()


def whole(text, count):
    return CountedText(text, count).total


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_random_edits(count, leaf):
    draw = random.Random(leaf)
    bits = ["a", "word", " ", "  ", "\n", "\n\n", "'s", "'", "12", "é", "ß!", "...", "\t", "don't", " x", "日本", "7a"]
    for _ in range(150):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(0, 60)))
        held = CountedText(text, count, leaf)
        for _ in range(6):
            start = draw.randrange(-2, len(text) + 3)
            end = start + draw.choice([0, 0, 1, 2, 5, 30])
            new = "".join(draw.choice(bits) for _ in range(draw.choice([0, 1, 2, 40])))
            held.replace(start, end, new)
            low = min(max(start, 0), len(text))
            text = text[:low] + new + text[min(max(end, low), len(text)) :]
            fresh = CountedText(text, count)
            assert held.text == text
            assert [s for x in held.leaves for s in x.sizes] == [s for x in fresh.leaves for s in x.sizes], (text, start, end, new)
            assert held.total == fresh.total == sum(c for x in held.leaves for c in x.counts)
            assert held.chars[1] == len(text)


def test_small_edits_encode_little(count):
    held = CountedText("some words of a text that is rather long. " * 2000, count)
    held.replace(40000, 40003, "new")
    assert held.encoded < 20


def test_query(spark, count):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_edited_counts"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["n_tokens"] == whole(docs[r["doc_id"]], count) for r in rows)


def test_hard_rows(spark, count):
    rows = [(1, None, None), (2, "", [(0, 0, "x y")]), (None, "a b", [(1, 2, None), (0, 1, "")]), (3, "a", [(9, 99, " b")]), (3, "a", [(9, 99, " b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:bigint,end:bigint,new:string>>").withColumn("key", docs_key())
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_tokens_after"], r["edited_text"]) for r in counted(docs).collect()))
    assert got == [(0, 2, whole(" b", count), " b"), (1, 0, 0, ""), (2, 0, whole("x y", count), "x y"), (3, 1, 2, "a b"), (3, 1, 2, "a b")]
    assert counted(docs.limit(0)).count() == 0


def docs_key():
    from pyspark.sql import functions as F

    return F.lit("clash")
