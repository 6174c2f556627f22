"""Byte-level BPE against the tokenizer library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe
from corpusloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def library(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def ranks(request):
    return byte_bpe.read_ranks(public_tokenizers.path(request.param))


def check(docs, ranks, **options):
    table = byte_bpe.rank_map(ranks)
    rows = byte_bpe.encoded(docs, ranks, table=table, **options).withColumn("bytes", byte_bpe.decoded(F.col("ids"), table)).collect()
    encode = library(ranks)
    for row in rows:
        assert row["ids"] == encode(row["text"] or ""), row["text"]
        assert bytes(row["bytes"]) == (row["text"] or "").encode()
    return rows


HARD = [
    "", " ", "\n", "a", "don't we'll I'M 'S", "  two  blanks \n\n\t x y　z  ", "日本語の文章、とても長い。", "สวัสดีชาวโลก", "é é ß ſ İ ı ǆ",
    "😀👩‍👩‍👧 \U0001d54f", "١٢٣ 123456789 ½ Ⅷ", "x" * 3000, "ab" * 700 + "!" * 500 + " " * 400 + "=" * 99, "\x00\x01\x7f\x85 ", "<|endoftext|>", "a" * 17 + "b" * 16,
    "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen", '"quoted\\" \b\f',
]


@pytest.mark.parametrize("most", [0, 5, 1 << 17])
def test_hard_texts(spark, ranks, most):
    draw = random.Random(7)
    signs = "abeothn  '\n0é日ßx🙂.,ab"
    texts = [None, *HARD, *HARD[:3], *("".join(draw.choice(signs) for _ in range(draw.randrange(1, 90))) for _ in range(300))]
    rows = [(i if i % 7 else None, text, "clash", b"clash") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bytes binary")
    assert len(check(docs, ranks, most=most)) == len(texts)
    assert check(docs.limit(0), ranks, most=most) == []


def test_pieces_that_merges_do_not_give(spark):
    """The library looks a whole word up first; "abc" is a piece here that the merges of its bytes cannot give."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 300, b"bcd": 258, b" a": 301, b"aa": 302, b"aaa": 260}
    texts = ["abc", "abcd", "ab", " abc abc abcd", "aaaaaaa aaaa", "abcabc"]
    check(spark.createDataFrame([(t,) for t in texts], "text string"), ranks)
    check(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, most=0)


def test_long_text(spark, ranks):
    check(spark.createDataFrame([("Some words of a märchen, repeated. " * 20_000,)], "text string"), ranks, most=2)


def test_places_are_distinct(spark):
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 36, n))
        salt, size, masks, places = byte_bpe._places(keys)
        hashes = byte_bpe._hashes(keys | salt)
        assert len(set(places.tolist())) == len(keys)
        assert [((h >> byte_bpe.GROUP_BITS) ^ masks[h % len(masks)]) % size for h in hashes.tolist()] == places.tolist()
    told = spark.createDataFrame([(int(k | salt),) for k in keys], "k long").select(F.hash("k")).collect()
    assert [r[0] % (1 << 32) for r in told] == hashes.tolist()


def test_unknown_id(spark, ranks):
    table = byte_bpe.rank_map(ranks)
    with pytest.raises(Exception, match="an id has no piece"):
        spark.range(1).select(byte_bpe.decoded(F.array(F.lit(50256)), table)).collect()


def test_query(spark):
    encode = library(byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = encode(row["text"] or "")
        want.add((row["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((row["text"] or "").encode())))
    rows = QUERIES["op11_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_a_pair_of_the_first_id(spark):
    """The pair (0, 0) has no rank here; an empty place of the look-up must not stand for it."""
    ranks = {bytes([b]): b + 1 for b in range(256)} | {b"ab": 0}
    assert [r["ids"] for r in check(spark.createDataFrame([("abab",), ("ababab" * 20,)], "text string"), ranks)] == [[0] * 2, [0] * 60]


def test_rare_words_need_no_table(spark, ranks):
    """Every word occurs once: nothing is counted or collected beforehand, and each word is folded in its batch."""
    draw = random.Random(5)
    made = ["".join(draw.choice("abcdeghilmnorstuéßн日") for _ in range(draw.randrange(1, 60))) for _ in range(9000)]
    docs = spark.createDataFrame([(i, " ".join(made[30 * i:30 * i + 30])) for i in range(300)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("encode", "encode")
    rows = byte_bpe.encoded(docs, ranks)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("encode")) == []
    spark.sparkContext.setJobGroup("check", "check")
    encode = library(ranks)
    assert all(r["ids"] == encode(r["text"]) for r in rows.collect())


def test_long_words_have_a_heap(ranks):
    table, draw = byte_bpe.rank_map(ranks), random.Random(6)
    for size in (65, 200, 5000):
        word = "".join(draw.choice("abenrst日é") for _ in range(size))
        assert byte_bpe._folded_long(word.encode(), table) == library(ranks)(word)
