"""Vector codes against exact integers in plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import vector_codes
from corpusloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, rounds=6):
    """rows: (key, vector, label) -> sorted (key, label, code, error, label_error), digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    kept = [(k, [math.floor(4096 * x) for x in v], l) for k, v, l in kept]
    width = len(kept[0][1])
    cuts = [width * p // 8 for p in range(9)]
    part = lambda v, p: v[cuts[p] : cuts[p + 1]]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, total = [], {}
    for k, v, l in kept:
        found = [nearest(part(v, p), books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        total[l] = total.get(l, 0) + error
        out.append((k, l, "".join(f"{e:02x}" for _, e in found), error))
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    return sorted(((*r, total[r[1]]) for r in out), key=str), digest


def run(docs, **options):
    rows, books = vector_codes.compressed(docs, **options)
    return sorted((tuple(r) for r in rows.collect()), key=str), books.digest()


@pytest.mark.parametrize("width,n", [(16, 300), (8, 5), (13, 60), (3, 40), (64, 1)])
def test_random_vectors(spark, width, n):
    draw = random.Random(width)
    rows = [(draw.randrange(n), [draw.choice([-1.5, -0.25, 0.0, 1e-5, 0.125, 3.0, draw.gauss(0, 1)]) for _ in range(width)], draw.choice([None, 0, 1])) for _ in range(n)]
    rows += rows[: n // 3]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"key": F.lit(1), "code": F.lit("x"), "_label": F.lit(2)})
    assert run(docs.repartition(5)) == brute(rows)


def test_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [-inf, 0.0], 1), (None, [1.0, 2.0], None), (7, [0.5, -0.5], None), (7, [0.5, -0.5], None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert run(docs) == brute(rows)
    assert run(docs.where("vec_id < 6"))[0] == [] and run(docs.limit(0))[0] == []
    other = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r[2:4] for r in run(other)[0]] == [("00" * 8, 0), (None, None)]
    assert run(spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int"))[0] == [(1, 1, "00" * 8, 0, 0)]
    with pytest.raises(Exception, match="components must lie"):
        run(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int"))


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    got = QUERIES["op13_vector_codes"](spark, FOLDER).collect()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((k, c, e, t) for k, _, c, e, t in want)
