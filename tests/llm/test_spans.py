"""Substring dedup against brute force: real rows, and texts made to be hard."""

import pyarrow as pa
import pytest

from corpusloom.llm import bytewords
from corpusloom.llm.queries import QUERIES
from corpusloom.llm.recompression import repeated_spans_removed
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op1_repeated_spans"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(brute.repeated_spans(docs))


WORDS = [f"w{i * 7919 % 1000}" for i in range(900)]
HARD = [
    (1, "a " * 200), (2, "a " * 35), (3, "a " * 34), (4, None), (5, ""), (6, " \n\t "), (7, " ".join(WORDS[:80])),
    (8, "x " + " ".join(WORDS[10:60]) + " y"), (9, " ".join(WORDS[100:135])), (9, " ".join(WORDS[100:135])), (None, " ".join(WORDS[90:140])),
    (10, "a b " * 60), (11, "b a " * 20), (12, " é  " * 40), (13, " ".join(WORDS[200:900])), (14, " ".join(WORDS[200:500] + ["cut"] + WORDS[500:900])),
    (15, " ".join(WORDS[300:334])), (16, "Ä" * 300000), (17, ("a " * 30 + "z ") * 3),
]


@pytest.mark.parametrize("group_bytes", [300, 2_000_000])
def test_hard_texts(spark, group_bytes):
    docs = spark.createDataFrame([(*r, 1, 2) for r in HARD], "id long, text string, part int, name int")
    rows = repeated_spans_removed(docs, "id", group_bytes=group_bytes).collect()
    got = [(r["id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in rows]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(brute.repeated_spans(HARD), key=order)


def test_empty(spark):
    assert repeated_spans_removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_a_slice():
    texts = pa.array(["x", " a  b", None, "c", "", "d\te "])[1:]
    found = bytewords.words(texts)
    got = [[bytes(found.data[found.start[j] : found.end[j]]) for j in range(*found.text(i).indices(99))] for i in range(5)]
    assert got == [[b"a", b"b"], [], [b"c"], [], [b"d", b"e"]]
    assert len(set(found.hash.tolist())) == 5
