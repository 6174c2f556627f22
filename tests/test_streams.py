"""Streams over several batches: late rows, state that shrinks, turns in any order."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import jobs

SCHEMA = "request_id string, conversation_id string, request_created_at timestamp, query_type string, latency_ms double"


def batches(folder, parts):
    """One file a batch, in this order by modification time."""
    folder.mkdir()
    for i, rows in enumerate(parts):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def request(name, at, kind="x", latency=1.0):
    return {"request_id": name, "conversation_id": "u", "request_created_at": at, "query_type": kind, "latency_ms": latency}


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_late_rows_are_dropped_and_counted_and_state_shrinks(spark, tmp_path):
    first = [request(f"a{i}", f"2024-01-01T{i:02}:00:00", f"k{i}", float(i)) for i in range(20)]
    folder = batches(tmp_path / "in", [first, [request("b", "2024-01-03T12:00:00")], [request("d", "2024-01-03T12:30:00")], [request("late", "2024-01-01T05:00:00", "k5"), request("c", "2024-01-03T11:30:00")]])
    path = str(tmp_path / "out")
    told = jobs.drain(jobs.daily(stream(spark, folder)), "append", jobs.appending(path))
    rows = spark.read.parquet(path).collect()
    assert {(r["event_date"], r["query_type"], r["requests"], r["latency_mean"]) for r in rows} == {("2024-01-01", f"k{i}", 1, float(i)) for i in range(20)}
    assert told.late == 1 and told.batches >= 4
    assert told.most_state >= 20 and told.state == 1  # the day that is still open


def test_sliding_windows_tell_their_start(spark, tmp_path):
    folder = batches(tmp_path / "in", [[request("a", "2024-01-01T10:30:00"), request("b", "2024-01-01T23:30:00")]])
    path = str(tmp_path / "out")
    jobs.drain(jobs.daily(stream(spark, folder), slide="6 hours"), "complete", jobs.overwriting(path))
    got = {(r["window_start"], r["event_date"], r["requests"]) for r in spark.read.parquet(path).collect()}
    starts = ["2023-12-31 12:00:00", "2023-12-31 18:00:00", "2024-01-01 00:00:00", "2024-01-01 06:00:00", "2024-01-01 12:00:00", "2024-01-01 18:00:00"]
    assert got == {(s, s[:10], n) for s, n in zip(starts, (1, 1, 2, 2, 1, 1))}


def expected(turns):
    out = set()
    for conv in {c for c, _, _ in turns}:
        known = dict(sorted((t, r) for c, t, r in turns if c == conv and r in ("user", "assistant")))
        out |= {(conv, user, ai) for ai, user in jobs.paired(list(known.items())).items()}
    return out


@pytest.mark.parametrize("seed", [1, 8])
def test_turns_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    turns = [(c, t, draw.choice(["user", "assistant", "system"])) for c in range(12) for t in range(draw.randrange(1, 25))]
    mixed = turns[:]
    draw.shuffle(mixed)
    parts = [mixed[i::4] for i in range(4)]
    parts[3] += parts[0][:5]  # some arrive twice
    folder = batches(tmp_path / "in", [[dict(zip(("conv_id", "turn", "role"), r)) for r in part] for part in parts])
    found = jobs.drain_pairs(stream(spark, folder, "conv_id long, turn long, role string"), str(tmp_path / "out"))
    assert {tuple(r) for r in found.collect()} == expected(turns)
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert changes.select("batch_id").distinct().count() >= 3 and changes.where(F.col("user_turn").isNull()).count() > 0


def test_pairing_rule():
    assert jobs.paired([(1, "user"), (2, "user"), (3, "assistant"), (4, "assistant"), (6, "user"), (9, "assistant"), (10, "user")]) == {3: 2, 9: 6}
    assert jobs.paired([]) == jobs.paired([(1, "assistant")]) == {}


def test_upserts_that_come_late_or_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    write = jobs.upserting(path, "k", ["at"])
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, at int")
    write(frame([("a", 1, 5), ("b", 1, 1), (None, 7, 1)]), 0)
    write(frame([("a", 2, 4), ("b", 2, 2), ("b", 3, 2)]), 1)
    write(frame([]), 2)
    write(frame([("b", 9, 2)]), 3)  # as late as the one before, but written after it
    before = {p.name for p in (tmp_path / "t" / "batch_id=0").iterdir()}
    rows = {r["k"]: r["v"] for r in jobs.current_rows(spark.read.parquet(path)).collect()}
    assert rows == {"a": 1, "b": 9, None: 7}
    assert before == {p.name for p in (tmp_path / "t" / "batch_id=0").iterdir()}


def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d")]
    for kind in ("file", "folder"):
        (tmp_path / kind).mkdir()
    written = spark.createDataFrame(turns, jobs.TURN_SCHEMA)
    written.repartition(2, "turn").write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    written.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet", index=False)
    for kind in ("file", "folder"):
        found = {tuple(r) for r in jobs.run_pairs(spark, str(tmp_path / kind)).collect()}
        assert found == {(1, 0, 1), (2, 0, 1)}, kind
