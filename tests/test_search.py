"""Search operators against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators import dense, ranking, sparse
from corpusloom.operators.filters import metadata_filter
from corpusloom.plans import catalog, search
from corpusloom.plans.registry import Tables

WORDS = [f"w{i}" for i in range(30)]


def corpus(n=300, seed=1):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, 31)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(1, 25), p=odds / odds.sum()))) for i in range(n)]


def brute(docs, query, k):
    tokens = {i: t.split() for i, t in docs}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for i, t in tokens.items():
        tf = Counter(t)
        score = sum(q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w, q in Counter(query.split()).items() if tf[w])
        if score:
            out.append((-round(score, 6), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.mark.parametrize("prune, seed_postings", [(False, 0), (True, 1), (True, 40), (True, 10**6)])
def test_bm25(spark, prune, seed_postings):
    docs = corpus()
    index = sparse.build_index(spark.createDataFrame(docs, "child_id int, text string"))
    asked = [(0, "w0 w1 w29"), (1, "w25 w0 w0"), (2, "w28"), (3, "nothing"), (4, " ".join(WORDS))]
    got = sparse.bm25(spark.createDataFrame(asked, "query_id int, text string"), index, 7, prune=prune, seed_postings=seed_postings).collect()
    for q, text in asked:
        assert [r.child_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == brute(docs, text, 7)


@pytest.mark.parametrize("prune", [False, True])
def test_bm25_over_many_cells(spark, monkeypatch, prune):
    """Blocks of few chunks and queries, few sums at a time; ties, repeated and null keys, languages to match."""
    for name, size in (("CHUNK_BLOCK", 16), ("QUERY_BLOCK", 2), ("CELL", 64)):
        monkeypatch.setattr(sparse, name, size)
    docs = [*corpus(), *[(i + 300, t) for i, t in corpus(40)], (900, ""), (901, None)]
    langs = [(i, t, (None, "a", "b")[i % 3]) for i, t in docs]
    index = sparse.build_index(spark.createDataFrame(langs, "child_id int, text string, lang string"), keep=("lang",))
    asked = [(0, "w0 w1 w29"), (1, "w25 w0 w0"), (2, "w28"), (3, "nothing"), (None, "w1 w2"), (4, " ".join(WORDS))]
    queries = spark.createDataFrame([(q, t, lang) for q, t in asked for lang in ("a", "b")], "query_id int, text string, lang string")
    kept = {i: t for i, t in docs if t}
    plain = sparse.bm25(queries.where("lang = 'a'"), index, 7, prune=prune, seed_postings=20).collect()
    scoped = sparse.bm25(queries, index, 7, match={"lang": "lang"}, prune=prune, seed_postings=20).collect()
    for q, text in asked:
        assert [r.child_id for r in sorted((r for r in plain if r.query_id == q), key=lambda r: r["rank"])] == brute(kept.items(), text, 7)
        for lang in ("a", "b"):
            mine = [i for i in brute(kept.items(), text, 10**6) if ("", "a", "b")[i % 3] == lang][:7]
            assert [r.child_id for r in sorted((r for r in scoped if (r.query_id, r.lang) == (q, lang)), key=lambda r: r["rank"])] == mine


def test_few_ranked_rows_go_to_the_links(spark):
    """Ranked lists are few, links are one row per chunk: the links are not shuffled, whatever Spark's threshold."""
    ranked = spark.createDataFrame([(0, f"c{i}", i) for i in range(9)], "query_id int, child_id string, rank int")
    links = spark.range(5000).select(F.format_string("c%d", "id").alias("child_id"), F.format_string("p%d", F.floor(F.col("id") / 3)).alias("parent_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranking.backtrack(ranked, links, ["query_id"])
        assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
        assert sorted((r["rank"], r["parent_id"]) for r in found.collect()) == [(1, "p0"), (2, "p1"), (3, "p2")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_postings_are_not_dealt_before_a_search_asks(spark):
    index = sparse.build_index(spark.createDataFrame(corpus(), "child_id int, text string"))
    assert "Exchange" not in index.postings._jdf.queryExecution().toString()


def test_repeated_ids_and_vectors_of_other_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5])], "child_id int, embedding array<double>")
    asked = rows.select(F.col("child_id").alias("query_id"), "embedding")
    got = dense.nearest(asked.where("query_id = 1"), rows, 9, metric="dot", skip_self=True).collect()
    assert sorted((r["child_id"] or 0, r["score"]) for r in got) == [(0, 1.0), (0, 1.0), (2, 0.5), (2, 0.5)]
    with pytest.raises(Exception, match="different lengths"):
        dense.nearest(asked, rows.unionByName(spark.createDataFrame([(7, [1.0, 2.0, 3.0])], rows.schema)), 2).collect()


def test_han_runs_become_bigrams(spark):
    df = spark.createDataFrame([("检索 系统abc 好",)], "t string")
    assert df.select(words(F.col("t"))).first()[0] == ["检索", "系统", "abc", "好"]
    assert spark.createDataFrame([("向量检索",)], "t string").select(words(F.col("t"))).first()[0] == ["向量", "量检", "检索"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((200, 8))
    labels = [0 if i % 3 else int(i % 5) for i in range(200)]
    rows = [(i, labels[i], [float(x) for x in v]) for i, v in enumerate(data)]
    return data, labels, spark.createDataFrame(rows, "child_id int, label int, embedding array<double>")


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
@pytest.mark.parametrize("blocks", [(8192, 4096), (16, 7)])
def test_nearest_in_bounded_cells(points, metric, blocks):
    data, labels, df = points
    queries = df.withColumnRenamed("child_id", "query_id")
    got = dense.nearest(queries, df, 5, metric=metric, part=["label"], skip_self=True, vector_block=blocks[0], query_block=blocks[1]).collect()
    norm = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(200):
        score = {"l2": -((data - data[q]) ** 2).sum(1), "dot": data @ data[q], "cosine": norm @ norm[q]}[metric]
        want = sorted((-round(float(score[i]), 9), i) for i in range(200) if i != q and labels[i] == labels[q])[:5]
        assert [r.child_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_approximate_recall(points):
    _, _, df = points
    queries = df.withColumnRenamed("child_id", "query_id")
    exact = {(r.query_id, r.child_id) for r in dense.nearest(queries, df, 10, metric="cosine", skip_self=True).collect()}
    found = {(r.query_id, r.child_id) for r in dense.approximate(queries, df, 10, 8, bits=2, tables=10, skip_self=True).collect()}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_registered_approximate_recall(spark, folder):
    """The registered query with its own parameters against the exact one, on the embeddings table."""
    queries = catalog.QUERIES
    exact, found = ({(r.query_id, r.child_id) for r in queries[q](spark, f"/root/testdata/{folder}").collect()} for q in ("knn_cosine", "knn_approximate"))
    assert len(exact & found) / len(exact) >= 0.9


def test_approximate_recall_with_many_buckets(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(9999, None)], "child_id int, embedding array<double>")
    queries = df.withColumnRenamed("child_id", "query_id")
    exact = {(r.query_id, r.child_id) for r in dense.nearest(queries, df, 10, metric="cosine", skip_self=True).collect()}
    found = [(r.query_id, r.child_id) for r in dense.approximate(queries, df, 10, 16, bits=6, tables=2, skip_self=True).collect()]
    assert len(found) == len(set(found)) and len(exact & set(found)) / len(exact) >= 0.9
    assert dense.approximate(queries.limit(0), df, 10, 16).count() == 0 and dense.approximate(queries, df.limit(0), 10, 16).count() == 0


def test_mmr_prefers_variety(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.999, 0.04]), (2, [0.7, 0.714])]
    vectors = spark.createDataFrame(rows, "child_id int, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.05])], "query_id int, embedding array<double>")
    got = dense.mmr_search(queries, vectors, 2, 3, metric="cosine").orderBy("rank").collect()
    assert [r.child_id for r in got] == [1, 0] or [r.child_id for r in got] == [1, 2]
    assert dense.mmr_search(queries, vectors, 5, 3, metric="cosine").count() == 3


def test_fusion_order_and_ties(spark):
    schema = "query_id int, child_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], schema)
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], schema)
    got = ranking.fuse([(a, 0.5), (b, 0.5)], ["query_id"]).orderBy("rank").collect()
    assert [r.child_id for r in got] == ["y", "x", "z"]
    empty = ranking.fuse([(a, 0.5), (b.limit(0), 0.5)], ["query_id"]).orderBy("rank").collect()
    assert [r.child_id for r in empty] == ["x", "y"]


def test_backtrack_keeps_first_and_drops_unknown(spark):
    ranked = spark.createDataFrame([(1, "c1", 1), (1, "c9", 2), (1, "c2", 3), (1, "c3", 4)], "query_id int, child_id string, rank int")
    links = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", "p1")], "child_id string, parent_id string")
    got = ranking.backtrack(ranked, links, ["query_id"]).orderBy("rank").collect()
    assert [(r.parent_id, r["rank"]) for r in got] == [("p1", 1), ("p2", 2)]


def test_adaptive_depths(spark):
    sizes = {"a": 40, "b": 161, "c": 1000}
    df = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "scope string, i int")
    got = {r.scope: (r.k, r.fetch_k, r.rrf_k) for r in ranking.adaptive_k(df, ["scope"]).collect()}
    assert got == {"a": (10, 30, 5), "b": (17, 51, 9), "c": (50, 150, 25)}


def test_rerank_gate(spark):
    parents = spark.createDataFrame([(q, f"p{i}", i) for q, n in ((1, 8), (2, 25)) for i in range(1, n + 1)], "query_id int, parent_id string, rank int")
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha beta")], "query_id int, text string")
    texts = spark.createDataFrame([(f"p{i}", "alpha beta" if i in (19, 22) else "alpha" if i == 20 else "none") for i in range(1, 26)], "parent_id string, text string")
    got = ranking.rerank(parents, queries, texts, ["query_id"]).orderBy("query_id", "rank").collect()
    first, second = [r for r in got if r.query_id == 1], [r for r in got if r.query_id == 2]
    assert [r.parent_id for r in first] == [f"p{i}" for i in range(1, 9)] and not any(r.reranked for r in first)
    assert [r.parent_id for r in second] == ["p19", "p20", "p1", "p2", "p3", "p4", "p5"]
    assert ranking.rerank(parents, queries, texts, ["query_id"], enabled=False).count() == 16


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 9), (3, None, 7)], "id int, kind string, n int")
    ids = lambda f: sorted(r.id for r in df.where(metadata_filter(f)).collect())
    assert ids({"kind": ["a", "b"], "k": 3}) == [1, 2] and ids({"n": {"gt": 5, "lte": 9}}) == [2, 3]
    assert ids({"kind": {"exists": True}}) == [1, 2] and ids({"kind": "a"}) == [1] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        metadata_filter({"n": {"near": 1}})


def test_letter_embedding_counts_in_arrow(spark):
    """Unit vectors of letter counts; null for texts without letters a-z; no interpreted expression per letter."""
    texts = ["Abba Z", None, "", "日本 123", "K İx", "ß" * 3 + "é", "zz" * 5000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = frame.select("i", F.lower("text").alias("low"), dense.letter_embedding(F.col("text")).alias("v"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        counts = [float((row["low"] or "").count(c)) for c in dense.LETTERS]
        length = sum(x * x for x in counts) ** 0.5
        assert row["v"] == ([x / length for x in counts] if length else None)


def test_short_passages_are_found_in_documents(spark, tmp_path):
    """Passages of any number of words, cut anywhere: every document that holds one, none that does not."""
    bodies = ["the quick brown fox", "Foxes, quickly!", "brown\nfox", "大向量检索 fox 好", "量检 x", "ΟΔΟΣ. ΟΔΟΣΑΒ ab", "...", "a_b - c", "", None, "İx fox", "𝒜𝒷𝒸 fox", "no match"]
    documents = [(i, b, "en", "s", 0) for i, b in enumerate(bodies)] + [(0, "another fox", "en", "s", 0), (1, "Foxes, quickly!", "en", "s", 0)]
    rng = np.random.default_rng(8)
    passages = ["fox", "ox", "o", "quick brown", "ick bro", "ck", "n\nf", "量", "量检", "向量检", "检索 f", "ΔΟΣ", "ΟΣ ab", "ΟΔΟΣ", "x", "X", "..", " - ", ".", "", "𝒷", "quick brown fo", None, "absent", "zz top", "?"]
    for body in filter(None, bodies):
        for _ in range(6):
            at, to = sorted(rng.integers(0, len(body) + 1, 2))
            passages.append(body[at:to])
    asked = [*enumerate(passages), (0, "Foxes, quickly"), (None, "fox"), (3, "quick brown")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = search.containing_documents(Tables(spark, str(tmp_path))).distinct().collect()
    want = {(q, d) for q, p in asked for d, b, *_ in documents if q is not None and p is not None and b is not None and p in b}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    refs = {r["query_id"]: r["refs"] for r in catalog.QUERIES["passage_search_quality"](spark, str(tmp_path)).collect() if r["query_id"] is not None}
    assert refs == {q: sum(x == q for x, _ in want) for q, _ in asked if q is not None}
