"""Running values and pairing over groups cut into blocks, against plain loops."""

import random

from pyspark.sql import functions as F

from corpusloom.operators.batches import pair_batches
from corpusloom.operators.running import Running, position, running
from corpusloom.operators.dialogues import rounds, user_ai_pairs


def test_running_values_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    for size in (1, 7, 1000):
        out = running(df, ["g"], ["i"], F.floor(F.col("i") / size), {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v")), "l": Running("last", F.col("v"))})
        got = {(r.g, r.i): (r.s, r.m, r.l) for r in out.collect()}
        state = {}
        for g, i, v in rows:
            s, m, l = state.get(g, (0, None, None))
            if v is not None:
                s, m, l = s + v, v if m is None else max(m, v), v
            state[g] = (s, m, l)
            assert got[(g, i)] == (s, m, l)


def test_position(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    got = position(df, ["g"], ["id"], F.floor(F.col("id") / 9)).collect()
    assert all(r.position == r.id // 2 + 1 for r in got)


def fifo(files):
    queue = [(s, n + 1) for s, c in files for n in range(c)]
    out = []
    while queue:
        base = queue.pop(0)
        at = next((i for i, q in enumerate(queue) if q[0] != base[0]), None)
        partner = queue.pop(at) if at is not None else (None, None)
        out.append((len(out) + 1, *base, *partner))
    return out


def test_pairs_match_a_queue(spark):
    rng = random.Random(5)
    sets = {f"d{k}": [(i, rng.randint(1, 9)) for i in range(rng.randint(1, 40))] for k in range(8)}
    sets["one"] = [(0, 4)]
    sets["even"] = [(0, 1), (1, 1)]
    sets["heavy"] = [(0, 50), (1, 3), (2, 2)]
    df = spark.createDataFrame([(d, s, n) for d, fs in sets.items() for s, n in fs], "d string, seq long, n int")
    for size in (1, 3, 4096):
        rows = pair_batches(df, "d", "seq", "n", files_per_block=size).collect()
        for d, fs in sets.items():
            got = sorted((r.batch_index, r.base_seq, r.base_no, r.partner_seq, r.partner_no) for r in rows if r.d == d)
            assert got == fifo(fs), (d, size)


def test_two_files_pair_and_one_falls_back(spark):
    two = pair_batches(spark.createDataFrame([("x", 1, 1), ("x", 2, 1)], "d string, seq long, n int"), "d", "seq", "n").collect()
    assert [(r.batch_mode, r.base_seq, r.partner_seq) for r in two] == [("multi_file", 1, 2)]
    one = pair_batches(spark.createDataFrame([("x", 1, 1)], "d string, seq long, n int"), "d", "seq", "n").collect()
    assert [r.batch_mode for r in one] == ["single_file_fallback"]


TALK = [
    (1, 0, "system", "s", []), (1, 1, "user", "a", []), (1, 2, "user", "b", []), (1, 3, "tool", "t", []), (1, 4, "ai", "B", ["p"]), (1, 5, "ai", "C", ["p"]),
    (2, 0, "ai", "early", ["p"]), (2, 1, "user", "q", []), (2, 2, "ai", "no docs", []), (2, 3, "ai", "late", ["p"]), (2, 4, "user", "open", []),
]


def test_latest_question_meets_next_answer(spark):
    df = spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string, parent_doc_ids array<string>")
    for size in (1, 2, 4096):
        got = sorted((r.conv_id, r.user_turn, r.ai_turn, r.user_input, r.answer) for r in user_ai_pairs(df, size).collect())
        assert got == [(1, 2, 4, "b", "B"), (2, 1, 2, "q", "no docs")]
        kept = sorted((r.conv_id, r.turn, r["round"]) for r in rounds(df, size).collect())
        assert kept == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 5, 2), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 2)]
