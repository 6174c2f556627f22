"""Conversation logs: rounds, compaction, question-answer pairs, references.

A conversation may hold any share of the log, so nothing here puts a whole conversation into one task: running
values go through ordered blocks of turns, per-conversation values through partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.running import Running, running

PLACEHOLDER = "This is a tool message and its content has been omitted."
ROUNDS_TO_KEEP = 3
SUMMARIZE_THRESHOLD = 10
TURNS_PER_BLOCK = 4096


def _block(turn: str = "turn", size: int = TURNS_PER_BLOCK) -> Column:
    return F.floor(F.col(turn) / size)


def rounds(turns: DataFrame, block_size: int = TURNS_PER_BLOCK) -> DataFrame:
    """Add ``round`` (1-based, opened by each user turn); system turns and turns before the first user drop out."""
    kept = turns.where(F.col("role") != "system")
    opened = Running("sum", (F.col("role") == "user").cast("long"))
    return running(kept, ["conv_id"], ["turn"], _block(size=block_size), {"round": opened}).where(F.col("round") > 0)


def with_round_count(in_rounds: DataFrame) -> DataFrame:
    counts = in_rounds.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("round_count"))
    return in_rounds.join(counts, "conv_id")


def compact_tool_turns(turns: DataFrame, rounds_to_keep: int = ROUNDS_TO_KEEP) -> DataFrame:
    """Replace tool texts outside the last rounds by a placeholder. Applying it twice changes nothing more."""
    old = F.col("round") <= F.col("round_count") - rounds_to_keep
    compact = old & (F.col("role") == "tool") & (F.col("text") != PLACEHOLDER)
    rows = with_round_count(rounds(turns))
    return rows.withColumns({"replaced": compact, "text": F.when(compact, PLACEHOLDER).otherwise(F.col("text"))})


def summary_split(turns: DataFrame, threshold: int = SUMMARIZE_THRESHOLD, rounds_to_keep: int = ROUNDS_TO_KEEP) -> DataFrame:
    """Mark the turns to summarise in conversations with more rounds than the threshold."""
    rows = with_round_count(rounds(turns))
    old = (F.col("round_count") > threshold) & (F.col("round") <= F.col("round_count") - rounds_to_keep)
    return rows.withColumn("to_summarize", old)


def user_ai_pairs(turns: DataFrame, block_size: int = TURNS_PER_BLOCK) -> DataFrame:
    """(conv_id, user_turn, ai_turn, user_input, answer, parent_doc_ids): the latest user turn with the next AI turn.

    Only the first AI turn after a user turn answers it; whether it has documents is decided afterwards, so an
    answer without documents uses the question up.
    """
    talk = turns.where(F.col("role").isin("user", "ai"))
    is_user = F.col("role") == "user"
    counted = running(talk, ["conv_id"], ["turn"], _block(size=block_size), {"answers": Running("sum", (~is_user).cast("long"))})
    question = F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), F.col("answers").alias("answers"))
    marked = running(counted, ["conv_id"], ["turn"], _block(size=block_size), {"user": Running("last", F.when(is_user, question))})
    first_answer = (F.col("role") == "ai") & F.col("user").isNotNull() & (F.col("answers") == F.col("user.answers") + 1)
    return marked.where(first_answer).select(
        "conv_id", F.col("user.turn").alias("user_turn"), F.col("turn").alias("ai_turn"),
        F.col("user.text").alias("user_input"), F.col("text").alias("answer"), "parent_doc_ids",
    )


def answered_from(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Add the texts and files behind each answer; pairs without a known parent or file drop out."""
    keys = ["conv_id", "ai_turn"]
    wanted = pairs.select(*keys, F.posexplode("parent_doc_ids").alias("pos", "parent_id"))
    found = wanted.join(parents.select("parent_id", "file_id", "text"), "parent_id")
    evidence = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "file_id", "text"))).alias("_found"))
    files = F.array_distinct(F.transform("_found", lambda s: s["file_id"].cast("string")))
    texts = F.filter(F.transform("_found", lambda s: s["text"]), lambda x: x != "")
    return (
        pairs.join(evidence, keys)
        .withColumns({"reference_contexts": texts, "scope_file_ids": F.filter(files, lambda f: f.isNotNull() & (f != ""))})
        .drop("_found")
        .where(F.size("scope_file_ids") > 0)
    )


def references_by_file(messages: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Parents cited by each message, grouped by file; files and parents in order of first citation."""
    cited = messages.select(*keys, F.posexplode(F.array_distinct("parent_doc_ids")).alias("pos", "parent_id"))
    found = cited.join(parents.select("parent_id", "file_id"), "parent_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "parent_id")))
    return found.groupBy(*keys, "file_id").agg(
        F.min("pos").alias("first_pos"), F.transform(ordered, lambda s: s["parent_id"]).alias("parent_ids")
    )


def latest_by_role(turns: DataFrame, role: str) -> DataFrame:
    mine = turns.where(F.col("role") == role)
    return mine.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def carried_question(questions: DataFrame, update: Column, block_size: int = TURNS_PER_BLOCK) -> DataFrame:
    """The question in force at each user turn: the first one, then the latest whose verdict is "update"."""
    first = questions.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    rows = questions.join(first, "conv_id").withColumn("_takes", update | (F.col("turn") == F.col("_first")))
    carried = running(rows, ["conv_id"], ["turn"], _block(size=block_size), {"original_question": Running("last", F.when(F.col("_takes"), F.col("text")))})
    return carried.drop("_first", "_takes")


def rendered(role: Column, text: Column, tool_calls: Column | None = None) -> Column:
    """One line per message as a model's history; other roles are left out (null)."""
    ai = F.concat(F.lit("AIMessage: "), text)
    if tool_calls is not None:
        ai = F.when(F.coalesce(tool_calls, F.lit("")) != "", F.concat(F.lit("AIMessage: Use tools. "), tool_calls)).otherwise(ai)
    return (
        F.when(role == "user", F.concat(F.lit("HumanMessage: "), text))
        .when(role == "tool", F.concat(F.lit("ToolMessage: "), F.substring(text, 1, 100), F.lit("...")))
        .when(role == "ai", ai)
    )


def flattened(role: Column, text: Column, tool_calls: Column, tool_call_id: Column, status: Column) -> Column:
    """One message as a record; fields that do not belong to its kind are null."""
    return F.struct(
        F.when(role == "user", "human").otherwise(role).alias("type"),
        F.coalesce(text, F.lit("")).alias("content"),
        F.when(role == "ai", F.coalesce(tool_calls, F.array().cast("array<string>"))).alias("tool_calls"),
        F.when(role == "tool", tool_call_id).alias("tool_call_id"),
        F.when(role == "tool", status).alias("status"),
        F.when(role == "user", "human").alias("role"),
    )
