"""Readers, writers and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import registry_ops, samples as S
from corpusloom.sources import tables as T
from corpusloom.streaming import jobs


def test_texts_and_registry(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / "sub" / "b.py").write_text("pass")
    (tmp_path / "c.exe").write_text("no")
    texts = {r.path.rsplit("/", 1)[1]: (r.text, r.text_length) for r in T.read_texts(spark, str(tmp_path)).collect()}
    assert texts["a.md"] == ("# T\n\nx", 6) and texts["b.py"] == ("pass", 4)
    rows = registry_ops.registry_rows(T.list_files(spark, str(tmp_path)))
    assert {r.file_name for r in registry_ops.accepted(rows).collect()} == {"a.md", "b.py"}
    assert [r.reject_reason for r in registry_ops.rejects(rows).collect()] == ["unsupported_type:.exe"]


SEED = "question string, id string, reference_doc_ids array<string>"


@pytest.mark.parametrize("name, text", [
    ("s.jsonl", '﻿{"question":"q1","id":"1"}\n\n{"question":"q2","id":"2","reference_doc_ids":["d"]}\n'),
    ("s.json", '[{"question":"q1","id":"1"},{"question":"q2","id":"2","reference_doc_ids":["d"]}]'),
    ("u.json", '[\n  {"question":"q1","id":"1"},\n  {"question":"q2","id":"2","reference_doc_ids":["d"]}\n]\n'),
    ("t.json", '{"samples":[{"question":"q1","id":"1"},{"question":"q2","id":"2","reference_doc_ids":["d"]}]}'),
])
def test_seed_shapes(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    got = T.read_seed(spark, str(tmp_path / name), SEED).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("q1", "1", None), ("q2", "2", ["d"])]


def sample_rows(spark):
    unknown = "unknown"
    rows = [("a", 'say "hi", |x|', "ans\nwer", ["c"], ["d1", " d1", ""], ["f"], "single-hop-specific", unknown, ["t"])]
    df = spark.createDataFrame(rows, "sample_id string, user_input string, reference_answer string, reference_contexts array<string>, reference_doc_ids array<string>, scope_file_ids array<string>, query_type string, hop_count string, tags array<string>")
    extra = {c: F.lit(unknown) for c in ("abstraction_level", "evidence_topology", "query_type_source", "difficulty_level", "scenario_type")}
    return S.normalize(df.withColumns({**extra, "review_status": F.lit("pending"), "review_notes": F.lit(""), "capabilities": F.array().cast("array<string>")}))


def test_dataset_round_trip(spark, tmp_path):
    rows = sample_rows(spark)
    first = rows.first()
    assert (first.query_type, first.hop_count, first.abstraction_level, first.reference_doc_ids) == ("single_hop_specific", "single", "specific", ["d1"])
    path = T.write_dataset(rows, S.manifest(rows, name="n", version="v", category="regression", source_type="manual", metadata={"k": "v"}), S.review_sheet(rows), str(tmp_path), "regression", "n", "v")
    back, manifest = T.read_dataset(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))
    assert manifest.first().sample_count == 1 and manifest.first().metadata.k == "v"
    sheet = T.read_review_sheet(spark, f"{path}/review_sheet").collect()
    assert len(sheet) == 1 and sheet[0].sample_id == "a" and sheet[0].reference_doc_ids == "d1"


def test_old_run_records(spark, tmp_path):
    records = spark.createDataFrame([("a", ["x", "x", "y"])], "sample_id string, actual_doc_ids array<string>")
    row = T.with_run_defaults(records).first()
    assert row.actual_doc_ids == ["x", "y"] and row.status == "success" and row.query_type == "unknown" and row.tags == []
    path = T.write_run(records, spark.createDataFrame([("bm25",)], "retriever string"), str(tmp_path), "r1")
    assert spark.read.parquet(f"{path}/records").count() == 1
    a = spark.createDataFrame([("a", 1.0)], "sample_id string, recall double")
    b = spark.createDataFrame([("b", 2.0)], "sample_id string, mrr double")
    assert T.write_scores_csv([a, b], str(tmp_path / "scores")) == ["sample_id", "recall", "mrr"]


def test_daily_partitions(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "request_id string, event_date string")
    T.write_daily(rows, path)
    day = T.read_day(spark, path, "request_id string", "2024-01-02")
    assert [r.request_id for r in day.collect()] == ["b"] and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().toString()
    assert T.read_day(spark, path, "request_id string", "2024-03-03").count() == 0
    T.overwrite_days(rows.where("request_id = 'b'").withColumn("request_id", F.lit("c")), path)
    assert T.read_day(spark, path, "request_id string", "2024-01-02").first().request_id == "c"
    assert T.read_day(spark, path, "request_id string", "2024-01-01").count() == 1


def test_publish_switches_all_tables(spark, tmp_path):
    root = str(tmp_path)
    T.publish({"parents": spark.range(2), "children": spark.range(4)}, root, "1")
    T.publish({"parents": spark.range(3), "children": spark.range(6)}, root, "2")
    assert T.published(spark, root, "parents").count() == 3 and T.published(spark, root, "children").count() == 6


def test_stream_upsert_over_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.upserting(path, "k", ["at"])
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], "k string, v1 int, at int")
    second = spark.createDataFrame([("b", 5, 3), ("c", 6, 3), (" ", 9, 9)], "k string, v1 int, at int")
    write(first, 0)
    for _ in range(2):  # a retried batch changes nothing
        write(second, 1)
        rows = jobs.current_rows(spark.read.parquet(path)).collect()
        assert sorted((r.k, r.v1) for r in rows if r.k.strip()) == [("a", 2), ("b", 5), ("c", 6)]


def test_late_rows_and_sessions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"request_id": "1", "conversation_id": "u", "request_created_at": "2024-01-01T00:00:00", "query_type": "x", "latency_ms": 1.0}]
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in lines * 2))
    schema = "request_id string, conversation_id string, request_created_at timestamp, query_type string, latency_ms double"
    stream = spark.readStream.schema(schema).json(str(source))
    out = str(tmp_path / "out")
    jobs.drain(jobs.once(stream), "append", jobs.appending(out))
    assert spark.read.parquet(out).count() == 1
    out2 = str(tmp_path / "out2")
    jobs.drain(jobs.daily(spark.readStream.schema(schema).json(str(source)), slide="1 hour"), "complete", jobs.overwriting(out2))
    assert spark.read.parquet(out2).count() == 24
