"""An index that follows changes, against one built anew after each of them."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import index_table, sparse

WORDS = [f"w{i}" for i in range(15)]


def chunks(draw, parents):
    rows = []
    for p in parents:
        for c in range(draw.randrange(1, 4)):
            rows.append((f"{p}:{c}", p, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(0, 7))), draw.randrange(3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "child_id string, parent_id string, text string, page int")


def check(spark, index, rows):
    got, want = index_table.searchable(index, spark), sparse.build_index(frame(spark, rows))
    for name, columns in (("postings", ["term", "child_id", "tf", "dl"]), ("term_stats", ["term", "df"])):
        have, need = (sorted(tuple(r) for r in getattr(side, name).select(*columns).collect()) for side in (got, want))
        assert have == need
    assert index.forward(spark).count() == len(rows)
    pages = {r["child_id"]: r["page"] for r in index.forward(spark).collect()}
    assert pages == {r[0]: r[3] for r in rows}
    n, avgdl = got.corpus.first()
    assert n == sum(bool(r[2]) for r in rows)
    if n:
        assert avgdl == pytest.approx(want.corpus.first()["avgdl"])
        asked = spark.createDataFrame([(0, "w1 w2"), (1, "w3"), (2, "w9 w0 w14")], "query_id int, text string")
        for prune in (False, True):
            assert sparse.bm25(asked, got, 4, prune=prune).collect() == sparse.bm25(asked, want, 4, prune=prune).collect()


def files(spark, index):
    rows = spark.read.schema(index.schema).parquet(f"{index.path}/forward").select("bucket", F.col("_metadata.file_path").alias("f")).distinct()
    return {(r["bucket"], r["f"]) for r in rows.collect()}


def test_replaces_and_deletes_equal_a_rebuild(spark, tmp_path):
    draw = random.Random(4)
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=7)
    rows = chunks(draw, [f"p{i}" for i in range(40)])
    index_table.create(index, frame(spark, rows))
    check(spark, index, rows)
    for step in range(3):
        written = [f"p{draw.randrange(60)}" for _ in range(3)]
        gone = {f"p{draw.randrange(50)}" for _ in range(3)} - set(written)
        new = chunks(draw, sorted(set(written)))
        before = files(spark, index)
        deleted = spark.createDataFrame([(p,) for p in [*gone, "unknown", None]], "parent_id string")
        index_table.change(index, f"b{step}", frame(spark, new), deleted if step else None)
        rows = [r for r in rows if r[1] not in written and not (step and r[1] in gone)] + new
        check(spark, index, rows)
        ids = [*written, *(gone | {"unknown"} if step else [])]
        touched = {r[0] for r in spark.createDataFrame([(p,) for p in ids], "parent_id string").select(index.bucket()).collect()}
        assert {b for b, _ in files(spark, index) ^ before} == touched
    index_table.compact(index, spark, ["0", "b0", "b1"], "b0")
    check(spark, index, rows)
    assert index.changes(spark, "terms").where("batch = 'b1' and df <> 0").count() == 0


def test_a_batch_that_broke_off(spark, tmp_path):
    """Differences are written first; if the rest was lost, the same batch again gives what it would have given."""
    draw = random.Random(9)
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=3)
    rows = chunks(draw, ["a", "b", "c", "d"])
    index_table.create(index, frame(spark, rows))
    new = chunks(draw, ["b", "e"])
    want = [r for r in rows if r[1] not in ("b", "c")] + new
    gone = spark.createDataFrame([("c",)], "parent_id string")
    for _ in range(2):
        index_table.change(index, "x", frame(spark, new), gone)
        check(spark, index, want)
    again = chunks(draw, ["a"])
    index_table._record(index, "y", *index_table._difference(index_table._chunks(index, frame(spark, again)), index.forward(spark).where("parent_id = 'a'")))
    index_table.change(index, "y", frame(spark, again))
    check(spark, index, [r for r in want if r[1] != "a"] + again)


def test_everything_goes(spark, tmp_path):
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=4)
    rows = chunks(random.Random(2), ["a", "b"])
    index_table.create(index, frame(spark, rows))
    index_table.change(index, "all", deleted=spark.createDataFrame([("a",), ("b",), ("a",)], "parent_id string"))
    check(spark, index, [])
    index_table.change(index, "back", frame(spark, rows))
    check(spark, index, rows)
    index_table.change(index, "none", frame(spark, []))
    check(spark, index, rows)
    empty = index_table.IndexTable(str(tmp_path / "empty"), keep="page int")
    index_table.create(empty, frame(spark, []))
    check(spark, empty, [])


def stands(spark, index, rows):
    """Chunks and statistics as those of an index built anew."""
    got, want = index_table.searchable(index, spark), sparse.build_index(frame(spark, rows))
    assert sorted((r["child_id"], r["page"]) for r in index.forward(spark).collect()) == sorted((r[0], r[3]) for r in rows)
    for name, columns in (("postings", ["term", "child_id", "tf", "dl"]), ("term_stats", ["term", "df"]), ("corpus", ["n", "avgdl"])):
        have, need = (sorted(tuple(r) for r in getattr(side, name).select(*columns).collect()) for side in (got, want))
        assert have == need


def test_a_change_rewrites_nothing(spark, tmp_path):
    """A change of every bucket adds files and leaves those that are there as they are."""
    draw = random.Random(12)
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=5)
    rows = chunks(draw, [f"p{i}" for i in range(60)])
    index_table.create(index, frame(spark, rows))
    before = files(spark, index)
    new = chunks(draw, [f"p{i}" for i in range(0, 60, 2)])
    index_table.change(index, "half", frame(spark, new), spark.createDataFrame([("p1",), ("p3",)], "parent_id string"))
    assert before < files(spark, index)
    rows = [r for r in rows if int(r[1][1:]) % 2 and r[1] not in ("p1", "p3")] + new
    stands(spark, index, rows)
    index_table.settle(index, spark)
    assert index.stored(spark, True).isEmpty() and index.stored(spark, False).count() == len(rows)
    stands(spark, index, rows)
    index_table.change(index, "later", frame(spark, chunks(draw, [])), spark.createDataFrame([("p2",)], "parent_id string"))
    stands(spark, index, [r for r in rows if r[1] != "p2"])


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_marks_shuffled_or_broadcast(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(index_table, "BROADCAST", most)
    draw = random.Random(13)
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=3)
    rows = chunks(draw, [f"p{i}" for i in range(30)])
    index_table.create(index, frame(spark, rows))
    for step in range(3):  # the same parents go and come again
        new = chunks(draw, ["p1", "p2", f"p{step + 5}"])
        index_table.change(index, f"b{step}", frame(spark, new), spark.createDataFrame([("p9",), ("p2",)], "parent_id string"))
        rows = [r for r in rows if r[1] not in ("p1", "p2", f"p{step + 5}", "p9")] + new
        stands(spark, index, rows)


def test_chunks_are_made_once_and_dealt_as_texts(spark, tmp_path, monkeypatch):
    """Rows of the index go from the text to their files without a shuffle or a table in between; nothing shuffled stays."""
    draw = random.Random(14)
    tables, plans, frees = [], [], []
    durable, overwrite = index_table.durable, index_table._overwrite

    def written(rows, path, *by, whole=False):
        if path.endswith("forward"):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            frees.append(spark.conf.get(session.FREES))
        overwrite(rows, path, *by, whole=whole)

    monkeypatch.setattr(index_table, "durable", lambda df: tables.append(df.columns) or durable(df))
    monkeypatch.setattr(index_table, "_overwrite", written)
    index = index_table.IndexTable(str(tmp_path / "index"), keep="page int", buckets=5)
    rows = chunks(draw, [f"p{i}" for i in range(20)])
    index_table.create(index, index_table.deal(index, frame(spark, rows)), dealt=True)
    new = chunks(draw, ["p1", "p2"])
    index_table.change(index, "b", index_table.deal(index, frame(spark, new)), dealt=True)
    assert len(plans) == 2 and all(p.count("Exchange") == 1 and "counts" not in p[p.index("Exchange") :] for p in plans)
    assert not any("counts" in columns for columns in tables)
    assert frees == ["true"] * 2 and spark.conf.get(session.FREES) == "false"
    monkeypatch.undo()
    stands(spark, index, [r for r in rows if r[1] not in ("p1", "p2")] + new)
