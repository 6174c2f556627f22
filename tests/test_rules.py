"""Stated values: allocation, availability, validation, metrics, review, upsert, error classes."""

import math

from pyspark.sql import functions as F

from corpusloom.functions import allocation as A
from corpusloom.functions import metrics as M
from corpusloom.functions import querytype as Q
from corpusloom.operators import dense, filters, online, ranking, samples, sampling, scoring


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_allocation(spark):
    row = one(spark, A.allocate(F.lit(20), A.profile("balanced")), A.allocate(F.lit(20), A.profile("multihop_focus")), A.allocate(F.lit(3), A.profile("balanced")), A.allocate(F.lit(0), A.profile("balanced")))
    assert list(row) == [[5, 5, 5, 5], [2, 2, 8, 8], [1, 1, 1, 0], [0, 0, 0, 0]]


def test_distribution(spark):
    text = lambda *v: F.array(*[F.lit(x) for x in v])
    row = one(spark, A.normalized(text("1", "-2", "abc", "3")), A.normalized(text("0", "NaN", "x", "-1")))
    assert row[0] == [0.25, 0.0, 0.0, 0.75] and row[1] == [0.1, 0.1, 0.4, 0.4]


def test_availability(spark):
    row = one(spark, A.available_types(F.lit(2), F.lit(2), F.lit(1)), A.available_types(F.lit(2), F.lit(2), F.lit(1), multi_file=True), A.available_types(F.lit(2), F.lit(3), F.lit(2), multi_file=True))
    assert list(row) == [[True, True, True, False], [True, True, False, False], [True] * 4]


def test_reallocation(spark):
    counts = F.array(*[F.lit(x) for x in (1, 2, 3, 4)])
    flags = lambda *v: F.array(*[F.lit(x) for x in v])
    for available, want in (((True, True, False, False), [4, 6, 0, 0]), ((False, False, True, False), [0, 0, 10, 0]), ((False,) * 4, [0] * 4), ((True,) * 4, [1, 2, 3, 4])):
        events = A.moves(counts, flags(*available))
        row = one(spark, A.moved_counts(counts, flags(*available), events), events)
        assert row[0] == want, available
        assert sum(row[0]) + sum(e.moved for e in row[1] if e.target is None) == 10


def test_error_classes(spark):
    kind = lambda c, m: F.struct(*[x.alias(n) for n, x in Q.error_class(F.lit(c), F.lit(m)).items()])
    row = one(spark, kind("X", "No relationships match the provided condition. Cannot form clusters."), kind("ReadTimeout", ""), kind("X", "Request Timed Out"), kind("X", "?"))
    assert [(r.retriable, r.category) for r in row] == [(False, "cluster_missing"), (True, "transient_runtime"), (True, "transient_runtime"), (True, "unknown")]


SAMPLES = [
    ("a", "what is x", "multi_hop_specific", ["d1"], []), ("b", "explain x", "single_hop_abstract", ["d1", "d2"], []),
    ("c", "what is y", "single_hop_abstract", ["d1"], []), ("d", "compare x and y", "multi_hop_abstract", ["d1", "d2"], []),
]


def test_validation(spark):
    df = spark.createDataFrame(SAMPLES, "sample_id string, user_input string, query_type string, reference_doc_ids array<string>, reference_file_ids array<string>")
    df = df.withColumn("reasoning_hops", F.array().cast("array<string>"))
    for mode, want in (("warn", (4, 4, 0, 2, 1)), ("strict", (4, 2, 2, 2, 1)), ("off", (4, 4, 0, 0, 0))):
        assert tuple(samples.validation_counts(df, mode)[0].first()) == want
    assert samples.validate(df, "strict").count() == 2


def test_heuristic(spark):
    none, two = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    kind = lambda t, ids: F.struct(*[c.alias(n) for n, c in Q.detect(F.lit(t), ids, none).items()])
    row = one(spark, kind("How does it depend?", two), kind("show it", none), kind("impact between", none), kind("Summary", two))
    assert [(r.query_type, r.confidence, r.reasons) for r in row] == [
        ("multi_hop_abstract", 0.95, ["abstract_keyword", "multi_evidence", "multi_keyword"]), ("single_hop_specific", 0.55, []),
        ("multi_hop_specific", 0.65, ["multi_keyword"]), ("multi_hop_abstract", 0.9, ["abstract_keyword", "multi_evidence"]),
    ]


def test_metrics(spark):
    ids = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    row = one(spark, *[fn(ids(), ids("r"), 5) for fn in M.METRICS.values()])
    assert list(row) == [0, 0, 0, 0, 0]
    row = one(spark, *[fn(ids("x", "r", "y", "s"), ids("r", "s", "t"), 3) for fn in M.METRICS.values()])
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert [round(x, 9) for x in row] == [round(x, 9) for x in (1 / 3, 1 / 3, 1.0, 0.5, (1 / math.log2(3)) / ideal)]
    assert list(one(spark, *[fn(ids("x"), ids(), 3) for fn in M.METRICS.values()])) == [None] * 5


def test_review(spark):
    df = spark.createDataFrame([("a", "pending", "", "easy", "general"), ("b", "pending", "n", "easy", "general")], "sample_id string, review_status string, review_notes string, difficulty_level string, scenario_type string")
    sheet = spark.createDataFrame([("a ", "approved", "", " hard", None), ("b", "rejected", "", "", ""), ("zz", "approved", "", "", "")], df.schema)
    got = samples.apply_review(df, sheet).collect()
    assert [tuple(r)[:5] for r in got] == [("a", "approved", "", "hard", "general")]


def test_upsert_is_idempotent(spark):
    schema = "request_id string, v int, at int"
    target = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], schema)
    changes = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1), (" ", 9, 1), (None, 9, 1)], schema)
    once = online.upsert(target, changes, "request_id", ["at"])
    assert sorted((r.request_id, r.v) for r in once.collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, online.upsert(once, changes, "request_id", ["at"]).collect())) == sorted(map(tuple, once.collect()))
    assert tuple(online.upsert_counts(target, changes, "request_id").first()) == (1, 1, 2)


def test_chunk_quotas(spark):
    files = [("d", i, c) for i, c in enumerate([1, 5, 40, 2])] + [("tiny", 9, 3)]
    df = spark.createDataFrame(files, "d string, f int, n int")
    for budget in (2, 4, 10, 48, 100):
        got = sampling.chunk_quotas(df, "d", "f", "n", budget).collect()
        mine = {r.f: r.allocated_quota for r in got if r.d == "d"}
        assert sum(mine.values()) == min(budget, 48) and all(mine[i] <= c for _, i, c in files[:4])
        assert budget < 4 or min(mine.values()) >= 1


def test_weighted_sample_follows_weights(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), "id", F.when(F.col("id") < 300, 9.0).otherwise(1.0).alias("w"))
    heavy = sampling.weighted_sample(df, ["g"], "id", "w", 300).where("id < 300").count()
    assert 110 < heavy < 190  # nine times the odds on a tenth of the rows: half of the early draws


def test_metric_failures(spark):
    values = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(float("nan")))
    errors = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("E: x"))
    out = scoring.isolate_failures(values, errors)
    row = one(spark, out["status"], F.map_keys(out["metrics"]), F.map_keys(out["metric_failures"]))
    assert list(row) == ["success", ["a"], ["b"]]


def test_deep_lists_are_not_cut(spark):
    ranked = spark.range(300).selectExpr("1 as query_id", "id as child_id", "cast(id + 1 as int) as rank", "id as parent_id")
    depths = spark.createDataFrame([(1, 200)], "query_id int, k int")
    assert ranking.cut(ranked, depths, ["query_id"], "k").count() == 200
    assert ranking.fuse([(ranked, 0.5), (ranked, 0.5)], ["query_id"]).count() == 300
    assert ranking.backtrack(ranked, ranked.select("child_id", "parent_id"), ["query_id"]).count() == 300


def test_distribution_sources_in_order(spark):
    rows = [(None, None), (None, ["1", "1", "0", "0"]), (["0", "0", "1", "0"], ["1", "1", "0", "0"])]
    df = spark.createDataFrame(rows, "j array<string>, f array<string>")
    got = [r[0] for r in df.select(A.resolved(F.col("j"), F.col("f"), "balanced")).collect()]
    assert got[0] == got[0] and sum(got[0]) == 1.0 and got[1] == [0.5, 0.5, 0.0, 0.0] and got[2] == [0.0, 0.0, 1.0, 0.0]
    assert got[0] != [0.1, 0.1, 0.4, 0.4]


def test_generated_rows_keep_their_source(spark):
    rows = spark.createDataFrame([(1, "a", 9, "own"), (1, "b", 9, None), (1, "c", 2, "")], "p int, q string, n int, query_type_source string")
    got = {r["q"]: r["query_type_source"] for r in filters.stamped(rows, ["p"], "q", "n", F.lit("t"), "made").collect()}
    assert got == {"a": "own", "b": "made"}


def test_mmr_keeps_scopes_apart(spark):
    vectors = spark.createDataFrame([(i, s, [float(i), 1.0, float(i % 2)]) for i in range(6) for s in "ab"], "child_id long, part string, embedding array<double>")
    queries = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0]), (0, "b", [1.0, 0.0, 0.0])], "query_id long, part string, embedding array<double>")
    rows = dense.mmr_search(queries, vectors, 3, 5, part=["part"]).collect()
    lists = {s: [r["child_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["part"] == s] for s in "ab"}
    assert len(rows) == 6 and all(len(set(v)) == 3 for v in lists.values()) and lists["a"] == lists["b"]


def test_text_or_list(spark):
    from corpusloom.functions.querytype import text_or_list

    told = {
        '"a"': ["a"], '["a"," b","",null,5,1.5,true]': ["a", " b", "", "5", "1.5", "true"], "null": [], '""': [], "0": [], "7": ["7"], "false": [], "true": ["true"],
        '"0"': ["0"], '"false"': ["false"], '{"y":1,"x":[2]}': ["x", "y"], "[]": [], "not json": [], '[["n"],{"k":1}]': ['["n"]', '{"k":1}'], '"é \\" ü"': ['é " ü'],
    }
    rows = spark.createDataFrame([(j,) for j in told] + [(None,)], "j string").select("j", text_or_list(F.col("j")).alias("a")).collect()
    assert {r["j"]: r["a"] for r in rows} == {**told, None: []}


def test_upsert_outcomes(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, at int")
    changes = spark.createDataFrame([("a", 2, 1), ("a", -9, 2), ("b", -1, 1), ("c", 5, 1), ("d", None, 1), (" ", 3, 1), (None, 3, 1), ("c", 6, 2)], "k string, v int, at int")
    result, outcomes = online.upsert_outcomes(target, changes, "k", ["at"], F.col("v") >= 0)
    assert {r["k"]: r["v"] for r in result.collect()} == {"a": 2, "b": 1, "c": 6}
    assert {tuple(r) for r in outcomes.collect()} == {("a", "updated", 1), ("b", "failed", 1), ("c", "inserted", 0), ("d", "failed", 1)}
    assert online.upsert_outcomes(target, changes.limit(0), "k", ["at"], F.lit(True))[1].count() == 0


def test_reviewed_in_order(spark):
    rows = spark.createDataFrame([("s3", "Approved "), ("s1", "pending"), ("s2", "rejected"), ("s0", None), ("s4", "approved")], "sample_id string, review_status string")
    assert [r["sample_id"] for r in samples.reviewed(rows, ["approved", " Pending"], 2).collect()] == ["s1", "s3"]
    assert samples.reviewed(rows, ["approved"]).count() == 2 and samples.reviewed(rows, [" "]).count() == 0


def test_run_records_keep_texts_and_files(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    ranked = spark.createDataFrame([("a", 2, "d2", 7, "y"), ("a", 1, "d1", 7, "x"), ("a", 3, "d1", 8, "x")], "sample_id string, rank int, doc_id string, file int, text string")
    rows = {r["sample_id"]: r for r in scoring.run_records(asked, ranked, also={"actual_file_ids": "file", "actual_contexts": "text"}).collect()}
    assert rows["a"]["actual_doc_ids"] == ["d1", "d2"] and rows["a"]["actual_file_ids"] == [7, 8] and rows["a"]["actual_contexts"] == ["x", "y", "x"]
    assert rows["b"]["actual_contexts"] == [] and (rows["a"]["status"], rows["b"]["status"]) == ("success", "empty")
    assert scoring.run_records(asked, ranked).columns == ["sample_id", "actual_doc_ids"]


def test_children_of(spark):
    from corpusloom.operators.registry_ops import children_of

    parents = spark.createDataFrame([("p",), ("q",), ("p",)], "parent_id string")
    children = spark.createDataFrame([("p", "c1"), ("p", "c2"), ("r", "c3")], "parent_id string, child_id string")
    found, refused = children_of(parents, children)
    assert sorted(r["child_id"] for r in found.collect()) == ["c1", "c2"] and [r["parent_id"] for r in refused.collect()] == ["q"]
