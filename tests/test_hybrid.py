"""Scopes, filters, MMR and depths in search, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import hybrid, selection

WORDS = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03}", f"p{i // 3:03}", i // 4, " ".join(rng.choice(WORDS, rng.integers(1, 9))), int(i % 7), None if i % 5 else "x") for i in range(240)]
    children = spark.createDataFrame(rows, "child_id string, parent_id string, file_id long, text string, page int, tag string")
    scopes = [(s, f) for s, keep in (("a", lambda f: f % 2 == 0), ("b", lambda f: f % 3 == 0), ("all", lambda f: True)) for f in range(60) if keep(f)]
    scopes += [("a", 0), ("a", None), (None, 1), ("empty", 999)]
    return rows, children, spark.createDataFrame(scopes, "scope_id string, file_id long"), {s: {f for t, f in scopes if t == s} for s in ("a", "b", "all")}


def test_bits_over_many_files(spark):
    """Numbers that cross bitmap borders, and both ends of a byte."""
    rows = spark.range(100_000).select(F.explode(F.array(F.lit("odd"), F.lit("seventh"), F.lit("all"))).alias("scope_id"), (F.col("id") * 3 + 5).alias("file_id"))
    rows = rows.where((F.col("scope_id") == "all") | ((F.col("scope_id") == "odd") & (F.col("file_id") % 2 == 1)) | (F.col("file_id") % 7 == 0))
    found = selection.scope_bits(rows.unionByName(rows.limit(10)))
    numbers = found.files()
    assert numbers.count() == 100_000 == numbers.agg(F.max("file_no")).first()[0]
    asked = numbers.crossJoin(spark.createDataFrame([("odd",), ("seventh",), ("all",), ("none",)], "scope_id string"))
    got = selection.in_scopes(asked, found).select("scope_id", "file_id")
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
    ordered = numbers.orderBy("file_no").limit(3).collect()
    assert [(r["file_no"], r["file_id"]) for r in ordered] == [(1, 5), (2, 8), (3, 11)]


def test_filter_bits(spark):
    rows = spark.createDataFrame([(1, "x"), (5, None), (None, "y"), (5, "y")], "page int, tag string")
    filters = {"late": {"page": {"gt": 2}}, "tagged": {"tag": {"exists": True}, "k": 3}, "some": {"tag": ["x", "z"], "page": 1}}
    bits = [r[0] for r in rows.select(selection.filter_bits(filters)).collect()]
    assert bits == [1 + 4 + 8, 1 + 2, 1 + 4, 1 + 2 + 4]
    named = spark.createDataFrame([(None,), ("some",)], "f string")
    assert [r[0] for r in named.select(selection.filter_number(filters, F.col("f"))).collect()] == [0, 3]
    with pytest.raises(Exception, match="unknown filter: other"):
        spark.createDataFrame([("other",)], "f string").select(selection.filter_number(filters, F.col("f"))).collect()
    with pytest.raises(ValueError):
        selection.filter_bits({str(i): {} for i in range(63)})


def greedy(vectors, query, k, weight):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors, query = unit(np.array(vectors)), unit(np.array(query))
    taken = []
    while len(taken) < min(k, len(vectors)):
        def gain(i):
            near = np.round(vectors[i] @ query, 9)
            return np.round(weight * near - (1 - weight) * max(np.round(vectors[i] @ vectors[j], 9) for j in taken), 9) if taken else near
        taken.append(max((i for i in range(len(vectors)) if i not in taken), key=lambda i: (gain(i), -i)))
    return taken


@pytest.mark.parametrize("weight", [0.0, 0.5, 1.0])
def test_mmr_of_uneven_groups(spark, weight):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1) + 0.05]) for i in range(40)]
    queries, fetched, want = [], [], {}
    for q in range(30):
        n, k = int(rng.integers(1, 12)), int(rng.integers(0, 9))
        ids = [int(x) for x in rng.choice(40, n, replace=False)]
        ask = [float(x) for x in rng.standard_normal(4)]
        queries.append((q, ask, k))
        fetched += [(q, c, r + 1) for r, c in enumerate(ids)]
        want[q] = [ids[i] for i in greedy([vectors[c][1] for c in ids], ask, k, weight)]
    got = hybrid.reselected(
        spark.createDataFrame(fetched, "query_id int, child_id int, rank int"), spark.createDataFrame(vectors, "child_id int, embedding array<float>"),
        spark.createDataFrame(queries, "query_id int, embedding array<double>, k int"), ["query_id"], weight=weight,
    ).collect()
    found = {q: [] for q in want}
    for row in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[row["query_id"]].append(row["child_id"])
        assert row["rank"] == len(found[row["query_id"]])
    for q, ids in want.items():
        # vectors are 32-bit floats here, so equal gains may be told apart differently; the first choice never is
        assert len(found[q]) == len(ids) and (not ids or found[q][0] == ids[0])
    assert sum(found[q] == ids for q, ids in want.items()) >= 27


def test_search_sees_only_its_scope_and_filter(spark, small):
    rows, children, scopes, files = small
    filters = {"early": {"page": {"lt": 3}}, "tagged": {"tag": {"exists": True}}}
    within = hybrid.corpus(children, scopes, filters=filters)
    asked = [(q, s, f"{WORDS[q]} {WORDS[q + 1]}", f, o) for q in range(6) for s in ("a", "b", "all", "empty") for f, o in ((None, None), ("early", 3), ("tagged", 40))]
    asked = [(i, *rest) for i, (_, *rest) in enumerate(asked)]
    questions = spark.createDataFrame(asked, "query_id int, scope_id string, text string, filter_id string, k_override int")
    ready = hybrid.ask(questions, within)
    assert ready.where("scope_id = 'empty'").count() == 0
    allowed = {None: lambda r: True, "early": lambda r: r[4] < 3, "tagged": lambda r: r[5] is not None}
    lists = {kind: {} for kind in ("terms", "mmr", "similarity")}
    for row in hybrid.term_list(ready, within).collect():
        lists["terms"].setdefault(row["query_id"], set()).add(row["child_id"])
    for kind in ("mmr", "similarity"):
        for row in hybrid.vector_list(ready, within, semantic=kind).collect():
            lists[kind].setdefault(row["query_id"], set()).add(row["child_id"])
    for i, scope, text, name, own in asked:
        if scope == "empty":
            continue
        seen = [r for r in rows if r[2] in files[scope] and allowed[name](r)]
        k = own or min(50, max(10, -(-sum(r[2] in files[scope] for r in rows) // 10)))
        hits = {r[0] for r in seen if set(r[3].split()) & set(text.split())}
        assert lists["terms"].get(i, set()) <= hits and len(lists["terms"].get(i, set())) == min(k, len(hits))
        fetch = min(3 * min(50, max(10, -(-sum(r[2] in files[scope] for r in rows) // 10))), sum(r[2] in files[scope] for r in rows))
        assert lists["similarity"][i] <= {r[0] for r in seen} and len(lists["similarity"][i]) == min(k, len(seen))
        assert lists["mmr"][i] <= {r[0] for r in seen} and len(lists["mmr"][i]) == min(k, fetch, len(seen))


def test_pruning_keeps_the_result(spark, small):
    _, children, scopes, _ = small
    within = hybrid.corpus(children, scopes, filters={"early": {"page": {"lt": 3}}})
    asked = [(q, s, " ".join(WORDS[q : q + 4]), f) for q in range(8) for s in ("a", "b") for f in (None, "early")]
    questions = spark.createDataFrame([(i, s, t, f, 4) for i, (_, s, t, f) in enumerate(asked)], "query_id int, scope_id string, text string, filter_id string, k_override int")
    ready = hybrid.ask(questions, within)
    plain, pruned = ({tuple(r) for r in hybrid.term_list(ready, within, prune=p).collect()} for p in (False, True))
    assert plain == pruned and plain


def test_whole_search(spark, small):
    rows, children, scopes, files = small
    within = hybrid.corpus(children, scopes)
    parents = children.select("parent_id", F.col("text")).dropDuplicates(["parent_id"])
    questions = spark.createDataFrame([(1, "a", "w1 w2"), (2, "b", "w3"), (3, "none", "w1"), (4, "all", "w4 w5 w6")], "query_id int, scope_id string, text string")
    got = hybrid.search(questions, within, parents).collect()
    assert {r["query_id"] for r in got} == {1, 2, 4}
    for row in got:
        home = {r[2] for r in rows if r[1] == row["parent_id"]}
        scope = {1: "a", 2: "b", 4: "all"}[row["query_id"]]
        assert home & files[scope] and row["rank"] <= 8
    with pytest.raises(ValueError):
        hybrid.search(questions, within, parents, semantic="other")
    none = hybrid.corpus(children.limit(0), scopes)
    assert hybrid.search(questions, none, parents).count() == 0
