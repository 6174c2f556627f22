"""Preference pairs for chat training: the common turns once as prompt, the rest as two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# How a turn is written.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Roles whose turns are trained on.
TRAINED = ("assistant",)


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's turns in order as an array of (at, role, text).

    A conversation is one record and becomes one row. A null role or text counts as empty; rows with a null key or turn
    belong to no conversation and are left out; repeated rows count once; of several turns with one number all stay, in
    the order of role and text.
    """
    rows = conversations.where(F.col(key).isNotNull() & F.col(turn).isNotNull())
    entry = F.struct(F.col(turn).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(entry)).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many first turns are equal in role and text."""

    def same(i: Column) -> Column:
        a, b = F.get(chosen, i), F.get(rejected, i)
        return (a["role"] == b["role"]) & (a["text"] == b["text"])

    shorter = F.least(F.size(chosen), F.size(rejected))
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~same(i))
    return F.when(shorter <= 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), shorter))


def rendered(turns: Column) -> Column:
    written = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return F.array_join(written, "")


def mask(turns: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """The spans [start, end) of the rendered turns, in characters, that the loss is taken on: text and closing mark of
    turns whose role is trained."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"].isin(*trained), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step)["spans"]


def formatted(pairs: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(key, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) from (key, chosen, rejected) turn arrays.

    The longest common beginning of turns, equal in role and text, is the prompt and is rendered once. A side without
    further turns has an empty completion and an empty mask. A null side counts as no turns.
    """
    none = F.array().cast(pairs.schema["chosen"].dataType)
    both = pairs.select("key", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = {side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in "cr"}
    both = both.select("key", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest["c"].alias("c"), rest["r"].alias("r"))
    return both.select(
        "key", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), mask(F.col("c"), trained).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), mask(F.col("r"), trained).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """(key, chosen, rejected): every conversation, and the same one with its last turn's text taken from its neighbour.

    Conversations 2n and 2n + 1 are neighbours. The chosen side is the conversation up to its last assistant turn, the
    rejected side the same turns with the text of the neighbour's last assistant turn. Conversations without one, or
    whose neighbour has none, make no pair.
    """
    turns = turns_of(conversations)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    rows = turns.withColumn("last", last).where(F.col("last").isNotNull())
    answer = F.get(F.col("turns"), F.col("last"))
    own = rows.select("key", F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), answer["at"].alias("at"))
    other = rows.select(F.col("key").bitwiseXOR(F.lit(1)).alias("key"), answer["text"].alias("text"))
    both = own.join(other, "key")
    changed = F.struct(F.col("at").alias("at"), F.lit("assistant").alias("role"), F.col("text").alias("text"))
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(changed))
    return both.select("key", "chosen", rejected.alias("rejected"))


__all__ = ["common_turns", "formatted", "mask", "neighbour_pairs", "rendered", "turns_of"]
