"""Line dedup, source mixing, quality rules and decontamination against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixture, risk_rules, site_lines
from corpusloom.llm.columns import spaced_words
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) == ""


def test_site_lines(spark):
    line, rows = "Menu | Home", []
    for i in range(20):
        rows.append((i, "a.com", f"{line}\nown line {i}\n  {line} \n\nshared by three" if i < 3 else f"{line}\nown {i}", 0))
    rows += [(30 + i, None, f"{line}\nx{i}", 0) for i in range(3)] + [(40, "b.com", f"{line}\nonly here", 0), (41, "b.com", None, 0), (42, "a.com", "", 0), (42, "a.com", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines int")
    got = {(r["doc_id"]): (r["text"], r["n_lines"], r["n_dropped"]) for r in site_lines.without_boilerplate(docs, most_share=0.2).collect()}
    assert got[0] == ("own line 0\n\nshared by three", 5, 2) and got[9] == ("own 9", 2, 1) and got[31] == ("x1", 2, 1)
    assert got[40] == (f"{line}\nonly here", 2, 0) and got[41] == (None, 0, 0) and got[42] == ("", 1, 0)
    assert site_lines.without_boilerplate(docs).count() == len(rows)
    assert site_lines.without_boilerplate(docs.limit(0)).count() == 0
    assert site_lines.without_boilerplate(docs).columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check_mix(docs: list[tuple], rows: list) -> None:
    """docs: (doc_id, source, text)."""
    size = [(d, s, len(brute.WORD.findall(t or ""))) for d, s, t in docs]
    per = defaultdict(int)
    for _, s, n in size:
        per[s] += n
    want = targets(per)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, n) for d, _, n in size)
    source_of = {(d, n): s for d, s, n in size}
    got = defaultdict(int)
    for r in rows:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == per[s] and math.isclose(r["target"], want[s], abs_tol=1e-6) and r["taken"] <= 3 * r["size"]
        got[s] += r["taken"]
    for s in per:
        assert abs(got[s] - want[s]) <= max(n for _, t, n in size if t == s) / 2 + 1e-6


def test_mix_query(spark):
    docs = [tuple(r) for r in documents(spark).select("doc_id", "source", "text").collect()]
    rows = QUERIES["op5_source_mix"](spark, FOLDER).collect()
    check_mix(docs, rows)
    assert sorted(rows) == sorted(QUERIES["op5_source_mix"](spark, FOLDER).collect())


def test_mix_hard(spark):
    docs = [(i, s, "w " * n) for i, (s, n) in enumerate([("b", 3), ("b", 5), (None, 40), (None, 0), ("z", 500), ("é", 20), ("a", 0), ("a", 0)])]
    docs += [(100, "c", None), (101, "c", " "), (102, "z", "w " * 500), (102, "z", "w " * 500), (103, "", "w w w")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    rows = mixture.taken(df, shards=5, blocks=3).collect()
    check_mix(docs, rows)
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += len(r["shards"])
    out = mixture.mixed(df, shards=5, blocks=3)
    assert out.columns == ["doc_id", "source", "text", "size", "copy", "shard"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixture.taken(df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_splitting_tree(spark, shards):
    quota = {"a": 0, "b": 7, "c": 100, None: 13, "": 2}
    rows = mixture.splitting_tree(spark.createDataFrame(list(quota.items()), "source string, quota long"), shards, "x").collect()
    parts = {r["source"]: [b - a for a, b in zip([0, *r["bounds"]], r["bounds"])] for r in rows}
    assert {s: sum(p) for s, p in parts.items()} == quota and all(len(p) == shards and min(p) >= 0 for p in parts.values())
    totals = [sum(p[i] for p in parts.values()) for i in range(shards)]
    assert max(totals) - min(totals) <= 3


def test_hypergeometric(spark):
    n, g, d = 30, 12, 9
    u = [(i + 0.5) / 4000 for i in range(4000)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    got = Counter(r[0] for r in df.select(mixture.hypergeometric(F.lit(n), F.lit(g), F.lit(d), F.col("u"))).collect())
    for k in range(10):
        p = math.comb(g, k) * math.comb(n - g, d - k) / math.comb(n, d)
        assert abs(got[k] / 4000 - p) < 6e-4


def test_measures(spark):
    texts = [r[0] for r in documents(spark).select("text").collect()] + HARD
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = risk_rules.measured(df).withColumn("base", risk_rules.base_failed()).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base"]) for r in rows}
    assert got == {i: brute.base_measures(t) for i, t in enumerate(texts)}


HARD = [None, "", " \n ", "a " * 8, "a " * 9, "a b c d e f g h a b c d e f g h", "x\nx\n x\n\n\nx", "é# $ <日本>\x0b|\x0cb", "w\r\nw\r\n", "b " * 3000, " ".join(map(str, range(5000)))]


def test_binomial_tail(spark):
    cases = [(0, 50), (3, 200), (17, 1000), (0, 1), (5, 100), (1500, 100000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        logs = [math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(0.02) + (r["n"] - j) * math.log(0.98) for j in range(r["k"] + 1)]
        want = sum(map(math.exp, logs)) if r["k"] < 0.02 * r["n"] else 1.0
        assert math.isclose(r["p"], want, rel_tol=1e-7)


def test_cutoffs_hold_their_promise(spark):
    good = [(i, "w " * 30 + ("# " * (i % 7) if i % 50 == 0 else ""), "en") for i in range(2000)]
    bad = [(5000 + i, "w# " * 40, "en") for i in range(20)]
    rows = [(d, re.sub(r"w", lambda m, c=iter(range(10**6)): f"w{next(c)}", t), lang) for d, t, lang in good + bad] + [(9999, None, None), (9998, "# " * 30, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good] + [(d, 0) for d, _, _ in bad], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in risk_rules.judged(docs, labels).collect()}
    assert not any(out[d]["kept"] for d, _, _ in bad) and "symbols" in out[5000]["failed_rules"]
    assert sum(not out[d]["kept"] for d, _, _ in good) <= 0.02 * len(good)
    assert not out[9999]["kept"] and out[9999]["base_failed"]
    without = {r["doc_id"]: r for r in risk_rules.judged(docs, labels.limit(0)).collect()}
    assert all(r["kept"] != r["base_failed"] for r in without.values())
    assert risk_rules.judged(docs.limit(0), labels).count() == 0


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item here"), (3, None), (4, "..."), (5, "Three four FIVE six seven eight nine ten eleven twelve"), (None, "no key at all"), (6, "É")]
TEXTS = [
    (1, "zero one, two THREE four five six seven eight nine ten eleven twelve thirteen"), (2, "a short-item here; short item here"), (3, None), (4, ""), (None, "short item here"),
    (5, "one two three four five six seven eight nine"), (6, "x é y É"), (7, "short item " * 5000 + "here"), (7, "short item here"), (7, "short item here"), (8, "no key at all"), (9, "no key at all, short item here"),
]


@pytest.mark.parametrize("most", [0, 50_000])
def test_decontamination(spark, most):
    docs = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"])), r["n_hit"] > 0) for r in decontaminate.hits(docs, items, most_grams=most).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(rows, key=order) == sorted(brute.benchmark_hits(TEXTS, ITEMS), key=order)
    kept = decontaminate.cleaned(docs, items, most_grams=most)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    spans = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(docs, items, "spans", most_grams=most).where("doc_id < 7").collect()}
    assert spans == {1: "zero thirteen", 2: "a", 3: None, 4: "", 5: TEXTS[5][1], 6: "x é y"}
    assert decontaminate.hits(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.hits(docs.limit(0), items).count() == 0


def test_decontamination_query(spark):
    docs = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op10_benchmark_hits"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(brute.benchmark_hits(docs, items))


def test_spaced_words(spark):
    texts = [" a  b\x0b\x0cc ", None, "", "\n", "x y z\x1fq"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spaced_words(F.col("t"))).collect()]
    assert got == [brute.WORD.findall(t or "") for t in texts]
