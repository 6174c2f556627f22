"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from corpusloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        i //= 16
    return out


def manifest(rows):
    """rows: (group, key, leaf, shown) -> sorted (key, leaf, subroot, root, proof, folded)."""
    groups = {}
    for group, key, leaf, shown in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf, shown))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (known, key, leaf, shown) in enumerate(sorted(groups[g])):
            path = way(trees[g], i) + way(top, k)
            node = shown
            for left, right in path:
                node = sha(left + node + right)
            out.append((key if known else None, leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [256, 257, 3], [1] * 40 + [272, 273], [70_000, 4096, 4097, 1], [1] * 300])
def test_trees_of_all_sizes(spark, sizes):
    rows = [(f"g{g:03}" if g else None, i, sha(f"{g}-{i}"), sha("other") if i % 5 == 2 else sha(f"{g}-{i}")) for g, n in enumerate(sizes) for i in range(n)]
    each = spark.createDataFrame([(g, n) for g, n in enumerate(sizes)], "g long, n long").select("g", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    name = F.when(F.col("g") > 0, F.format_string("g%03d", "g"))
    leaf = F.sha2(F.concat(F.col("g").cast("string"), F.lit("-"), F.col("i").cast("string")), 256)
    docs = each.select(F.rand(1).alias("x"), name.alias("source"), F.col("i").cast("long").alias("doc_id"), leaf.alias("leaf")).orderBy("x")
    got = merkle.proofs(docs, F.col("leaf"), F.when(F.col("doc_id") % 5 == 2, F.sha2(F.lit("other"), 256))).collect()
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got]
    assert sorted(found, key=str) == manifest(rows)
    assert all(r["verified"] == (r["doc_id"] % 5 != 2) for r in got)


def test_positions(spark):
    """The closed form against the order in which nodes are complete."""
    for n in (1, 2, 15, 16, 17, 31, 32, 33, 240, 255, 256):
        levels = [n]
        while levels[-1] > 1 and len(levels) <= merkle.HEIGHT:
            levels.append(-(-levels[-1] // 16))
        nodes = sorted((min((j + 1) * 16**m, n), m, j) for m, count in enumerate(levels) for j in range(count))
        rows = spark.createDataFrame([(m, j, at) for at, (_, m, j) in enumerate(nodes)], "level int, j long, at long")
        told = F.coalesce(*[F.when(F.col("level") == m, merkle.postorder(m, F.col("j"), F.lit(n).cast("long"))) for m in range(merkle.HEIGHT + 1)])
        assert rows.where(told != F.col("at")).count() == 0


def test_hard_rows(spark):
    rows = [(None, None, "a", None, 1), (None, 3, None, "x", 2), (None, 3, None, "x", 2), ("é", 1, "", "ß\n", None), ("e", 1, "b", None, 0), ("z", None, "c", "", 0), ("z", 1, "C" * 50_000, "", 0)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string, lang string, index int").withColumns({"group": F.lit(1), "n": F.lit("n"), "key": F.lit(0), "path": F.lit("p")})
    cols = ["doc_id", "source", "text", "lang", "index"]
    got = merkle.proofs(docs, merkle.leaf_digest([F.col(c) for c in cols]), F.lit(None).cast("string"))
    leaves = [(r["source"], r["doc_id"], h := sha("".join(field(r[c]) for c in cols)), h) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got.collect()), key=str) == manifest(leaves)
    assert all(r["verified"] for r in got.collect())
    assert merkle.proofs(docs.limit(0), F.lit("x"), F.lit("x")).collect() == []


def test_query(spark):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = []
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        told = sha("".join(field(row[c]) for c in cols))
        low = row["text"] and "".join(c.lower() if c.isascii() else c for c in row["text"])
        other = sha("".join(field(row[c]) for c in cols[:-1]) + field(low))
        leaves.append((row["source"], row["doc_id"], told, other if zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 else told))
    got = QUERIES["op12_merkle_manifest"](spark, FOLDER).collect()
    found = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got]
    assert sorted(found, key=str) == manifest(leaves)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got) and 0 < sum(not r["verified"] for r in got) < len(got)
