"""Generation batches: plan statistics, size limits, sub-batches, multi-file pairing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.running import Running, running


def plan_stats(chunks: DataFrame, keys: Sequence[str], text_length: str = "chars") -> DataFrame:
    """Total, mean and largest chunk length and the number of chunks per file."""
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"),
        F.sum(text_length).alias("total_chunk_chars"),
        F.round(F.avg(text_length), 6).alias("avg_chunk_chars"),
        F.max(text_length).alias("max_chunk_chars"),
    )


def dynamic_limits(plan: DataFrame, dataset: str, hard_cap: int = 0) -> DataFrame:
    """How many chunks of a file may go into one batch.

    The safe length is the smallest mean among files with the same quota. It is one small aggregate joined back, so
    a quota shared by most files never gathers them in one task.
    """
    requested = F.greatest(F.col("allocated_quota"), F.lit(1))
    base = F.least(requested, F.lit(hard_cap)) if hard_cap > 0 else requested
    safe = plan.groupBy(dataset, "allocated_quota").agg(F.min("avg_chunk_chars").alias("safe_avg_chunk_chars"))
    joined = plan.join(safe, [dataset, "allocated_quota"])
    budget = F.col("safe_avg_chunk_chars") * requested
    within = F.col("total_chunk_chars") <= budget * 1.1
    dynamic = F.greatest(F.floor(budget / F.greatest(F.col("avg_chunk_chars"), F.lit(1.0))).cast("int"), F.lit(1))
    return joined.withColumns(
        {
            "limit_reason": F.when(within, "within_safe_batch_budget").otherwise("dynamic_chars"),
            "effective_chunk_limit": F.when(within, base).otherwise(F.least(base, dynamic)),
        }
    )


def sub_batches(chunks: DataFrame, limits: DataFrame, keys: Sequence[str], index: str = "sample_index", text_length: str = "chars") -> tuple[DataFrame, DataFrame]:
    """(chunks with their batch number, one row per batch): consecutive chunks of a file in groups of its limit."""
    keys = list(keys)
    limit = F.greatest(F.col("effective_chunk_limit"), F.lit(1))
    sized = chunks.join(limits.select(*keys, "effective_chunk_limit", F.col("chunk_count").alias("_n")), keys)
    placed = sized.withColumns(
        {
            "sub_batch_index": (F.floor(F.col(index) / limit) + 1).cast("int"),
            "sub_batch_count": F.ceil(F.col("_n") / limit).cast("int"),
        }
    ).drop("_n", "effective_chunk_limit")
    batches = plan_stats(placed, [*keys, "sub_batch_index", "sub_batch_count"], text_length)
    return placed, batches


# --- pairing batches of different files ----------------------------------------------------------------------
#
# The queue holds each file's batches in one run. Its head file gives its batches, one by one, to the next files'
# first batches; whichever side has batches over is the new head. After a file of n batches the number left over is
# therefore |left - n|. That map has a small domain (no file has more than M batches), so a block of files is a table
# of M + 1 entries: blocks are tabulated in parallel, the tables are chained one lookup each, and every block is then
# replayed in parallel from its own start.


def _replay(left: int, owner: int, counts: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """(owner, owner's left before, file, pairs) per file of a block, and the state behind the block. Owner -1 = before."""
    steps = []
    for i, n in enumerate(counts):
        pairs = min(left, int(n))
        steps.append((owner, left, i, pairs))
        if int(n) > left:
            owner, left = i, int(n) - left
        else:
            left -= int(n)
    return steps, left, owner


def pair_batches(files: DataFrame, dataset: str, seq: str, count: str, files_per_block: int = 4096) -> DataFrame:
    """(dataset, seq, count) -> one row per output batch: base and partner (file seq, batch number), in queue order.

    ``partner_seq`` is null for a batch that found no other file. ``batch_index`` numbers a dataset's output from 1.
    """
    rows = files.select(dataset, seq, F.col(count).cast("int").alias("n")).withColumn("_block", F.floor(F.col(seq) / files_per_block))
    widths = rows.groupBy(dataset).agg(F.max("n").alias("_width"))
    kind = files.schema[dataset].dataType.simpleString()

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        state = np.arange(int(pdf["_width"].iloc[0]) + 1)
        owner = np.full(len(state), -1, dtype=np.int64)
        for at, n in zip(pdf[seq].to_numpy(), pdf["n"].to_numpy()):
            owner = np.where(n > state, at, owner)
            state = np.abs(state - n)
        return pd.DataFrame({dataset: [pdf[dataset].iloc[0]], "_block": [pdf["_block"].iloc[0]], "_state": [state.tolist()], "_owner": [owner.tolist()]})

    tables = rows.join(widths, dataset).groupBy(dataset, "_block").applyInPandas(
        tabulate, f"{dataset} {kind}, _block bigint, _state array<bigint>, _owner array<bigint>"
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left, owner = None, 0, -1
        for pdf in batches:
            out = []
            for name, block, state, owners in pdf.itertuples(index=False, name=None):
                if name != current:
                    current, left, owner = name, 0, -1
                out.append((name, block, left, owner))
                taken = owners[left]
                left, owner = int(state[left]), owner if taken < 0 else int(taken)
            yield pd.DataFrame(out, columns=[dataset, "_block", "_left", "_from"])

    # One short row per block of files; rows stream through in order.
    starts = tables.repartition(dataset).sortWithinPartitions(dataset, "_block").mapInPandas(
        chain, f"{dataset} {kind}, _block bigint, _left bigint, _from bigint"
    )
    counts = rows.select(dataset, F.col(seq).alias("_from"), F.col("n").alias("_from_n"))
    starts = starts.join(counts, [dataset, "_from"], "left").withColumn("_from_n", F.coalesce("_from_n", F.lit(0)))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        seqs, ns = pdf[seq].to_numpy(), pdf["n"].to_numpy()
        before, before_n = int(pdf["_from"].iloc[0]), int(pdf["_from_n"].iloc[0])
        steps, left, owner = _replay(int(pdf["_left"].iloc[0]), -1, ns)
        resolve = lambda i: (before, before_n) if i < 0 else (int(seqs[i]), int(ns[i]))
        out = [(*resolve(o), l, int(seqs[i]), p) for o, l, i, p in steps]
        frame = pd.DataFrame(out, columns=["base_seq", "base_n", "base_left", seq, "pairs"])
        frame.insert(0, dataset, pdf[dataset].iloc[0])
        last_seq, last_n = resolve(owner)
        frame["end_seq"], frame["end_n"], frame["end_left"] = last_seq, last_n, left
        return frame

    replayed = rows.join(starts, [dataset, "_block"]).groupBy(dataset, "_block").applyInPandas(
        replay,
        f"{dataset} {kind}, base_seq bigint, base_n bigint, base_left bigint, {seq} bigint, pairs bigint, end_seq bigint, end_n bigint, end_left bigint",
    )
    numbered = running(replayed, [dataset], [seq], F.floor(F.col(seq) / files_per_block), {"_through": Running("sum", F.col("pairs"))})
    unit = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    pairs = numbered.where(F.col("pairs") > 0).withColumn("_i", unit(F.col("pairs"))).select(
        dataset,
        (F.col("_through") - F.col("pairs") + F.col("_i")).alias("batch_index"),
        F.lit("multi_file").alias("batch_mode"),
        "base_seq",
        (F.col("base_n") - F.col("base_left") + F.col("_i")).alias("base_no"),
        F.col(seq).alias("partner_seq"),
        F.col("_i").cast("bigint").alias("partner_no"),
    )
    ends = numbered.groupBy(dataset).agg(
        F.max("_through").alias("_pairs"), F.max_by(F.struct("end_seq", "end_n", "end_left"), seq).alias("_end")
    )
    alone = ends.where(F.col("_end.end_left") > 0).withColumn("_i", unit(F.col("_end.end_left"))).select(
        dataset,
        (F.col("_pairs") + F.col("_i")).alias("batch_index"),
        F.lit("single_file_fallback").alias("batch_mode"),
        F.col("_end.end_seq").alias("base_seq"),
        (F.col("_end.end_n") - F.col("_end.end_left") + F.col("_i")).alias("base_no"),
        F.lit(None).cast("bigint").alias("partner_seq"),
        F.lit(None).cast("bigint").alias("partner_no"),
    )
    return pairs.unionByName(alone)
