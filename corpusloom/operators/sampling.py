"""Reproducible sampling: weights, weighted and uniform samples, chunk budgets, top-ups.

Random draws come from the md5 of a seed and a row's key, so a rerun or a lost executor draws the same rows.
Every rank is cut at a number known when the plan is made, so only the best rows of each task are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import hash_key, hash_unit
from corpusloom.operators.running import position, top_rows


def recency_weight(created_at: Column, parents: Column, now: str, tau_days: float) -> Column:
    """Newer and larger files weigh more; a missing date counts as ``tau`` days old, a future one as new."""
    seconds = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / 1e6
    age = F.coalesce(F.greatest(seconds / 86400.0, F.lit(0.0)), F.lit(float(tau_days)))
    recency = F.greatest(F.exp(-age / max(tau_days, 1e-6)), F.lit(1e-8))
    return recency * F.greatest(F.sqrt(F.greatest(parents, F.lit(1)).cast("double")), F.lit(1.0))


def weighted_sample(rows: DataFrame, keys: Sequence[str], row_id: str, weight: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows per group without replacement, chance growing with weight (exponential keys)."""
    keyed = rows.withColumn("_draw", -F.log(hash_unit(seed, F.col(row_id))) / F.col(weight))
    return top_rows(keyed, keys, [F.asc("_draw"), F.asc(row_id)], n, "draw_rank").drop("_draw")


def uniform_sample(rows: DataFrame, keys: Sequence[str], row_id: str, n: int, seed: str = "0") -> DataFrame:
    keyed = rows.withColumn("_draw", hash_key(seed, F.col(row_id)))
    return top_rows(keyed, keys, [F.asc("_draw"), F.asc(row_id)], n, "draw_rank").drop("_draw")


def chunk_quotas(files: DataFrame, dataset: str, file: str, count: str, budget: int, alpha: float = 0.7, seed: str = "0") -> DataFrame:
    """Share a chunk budget among a dataset's files: one each if it suffices, the rest by repeated draws weighted by
    remaining capacity to the power ``alpha``.

    The repeated draw is read off a race: unit j of a file arrives after the sum of exponential gaps whose rate is the
    capacity left, and the budget's earliest arrivals win. That has the same distribution and needs no loop.
    """
    totals = files.groupBy(dataset).agg(F.count_if(F.col(count) > 0).alias("_files"), F.count("*").alias("_rows"), F.sum(count).alias("_sum"))
    capped = F.least(F.lit(budget), F.col("_sum"))
    base = (capped >= F.col("_rows")).cast("int")
    sized = files.join(totals.select(dataset, base.alias("_base"), (capped - base * F.col("_files")).alias("_left")), dataset)
    sized = sized.withColumn("_base", F.when(F.col(count) > 0, F.col("_base")).otherwise(0))
    # No file can win more units than the budget, and a file's units arrive in order.
    units = F.least(F.col(count) - F.col("_base"), F.lit(budget)).cast("int")
    raced = sized.select(dataset, file, F.col(count).alias("_n"), "_base", "_left", F.explode(F.sequence(F.lit(0), units - 1)).alias("_unit")).where(units > 0)
    rate = F.greatest(F.pow((F.col("_n") - F.col("_base") - F.col("_unit")).cast("double"), F.lit(max(alpha, 0.0))), F.lit(1e-8))
    gap = -F.log(hash_unit(seed, F.col(file), F.col("_unit"))) / rate
    inside = Window.partitionBy(dataset, file).orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    arrivals = raced.withColumn("_arrival", F.round(F.sum(gap).over(inside), 12))
    winners = top_rows(arrivals, [dataset], [F.asc("_arrival"), F.asc(file), F.asc("_unit")], budget, "_place")
    won = winners.where(F.col("_place") <= F.col("_left")).groupBy(dataset, file).agg(F.count("*").alias("_won"))
    quota = F.col("_base") + F.coalesce("_won", F.lit(0))
    return sized.join(won, [dataset, file], "left").select(*files.columns, quota.cast("int").alias("allocated_quota"))


def pick_chunks(chunks: DataFrame, quotas: DataFrame, keys: Sequence[str], chunk: str, budget: int, seed: str = "0") -> DataFrame:
    """Each file's quota of chunks in random order, numbered from 0. ``quotas`` has keys and ``allocated_quota`` (≤ budget)."""
    picked = uniform_sample(chunks, keys, chunk, budget, seed)
    kept = picked.join(quotas.select(*keys, "allocated_quota"), list(keys)).where(F.col("draw_rank") <= F.col("allocated_quota"))
    return kept.withColumn("sample_index", F.col("draw_rank") - 1).drop("draw_rank")


def topup_counts(plan: DataFrame, dataset: str, file: str, remaining: int, quota: str = "allocated_quota", seq: str = "plan_seq") -> DataFrame:
    """Floor share by quota, then one each by quota (largest first, plan order next) for what is left.

    What is left is always less than the number of files. A file's place in that order is counted through blocks of
    plan order, so a dataset may have any number of files.
    """
    weight = F.greatest(F.col(quota), F.lit(1))
    totals = plan.groupBy(dataset).agg(F.sum(weight).alias("_total"))
    shared = plan.join(totals, dataset).withColumn("_share", F.floor(F.lit(remaining) * weight / F.col("_total")).cast("int"))
    assigned = shared.groupBy(dataset).agg((F.lit(remaining) - F.sum("_share")).alias("_left"))
    ordered = shared.withColumn("_down", -F.col(quota)).join(assigned, dataset)
    block = F.struct(F.col("_down"), F.floor(F.col(seq) / 4096).alias("b"))
    placed = position(ordered, [dataset], ["_down", seq], block, "_place")
    extra = (F.col("_place") <= F.col("_left")).cast("int")
    return placed.select(*plan.columns, (F.col("_share") + extra).alias("topup_count"))


def topup_chunks(chunks: DataFrame, used: DataFrame, wanted: DataFrame, keys: Sequence[str], chunk: str, most: int, seed: str = "0") -> DataFrame:
    """``topup_count`` chunks per file: unused ones first, then repeats drawn from all of the file's chunks.

    ``most`` bounds ``topup_count`` (the amount asked for in total).
    """
    keys = list(keys)
    asked = wanted.where(F.col("topup_count") > 0).select(*keys, "topup_count")
    fresh = uniform_sample(chunks.select(*keys, chunk).join(used.select(chunk), chunk, "left_anti"), keys, chunk, most, seed)
    first = fresh.join(asked, keys).where(F.col("draw_rank") <= F.col("topup_count")).select(*keys, chunk, F.col("draw_rank").alias("pick"), F.lit(False).alias("repeated"))
    # Repeats look up a position in the file's chunks; only the positions drawn are joined.
    pools = chunks.groupBy(*keys).agg(F.count("*").alias("_pool"))
    have = first.groupBy(*keys).agg(F.count("*").alias("_have"))
    short = asked.join(pools, keys).join(have, keys, "left").withColumn("_have", F.coalesce("_have", F.lit(0)).cast("int"))
    short = short.where(F.col("topup_count") > F.col("_have"))
    draws = short.select(*keys, "_pool", F.explode(F.sequence(F.col("_have") + 1, F.col("topup_count"))).alias("pick"))
    draws = draws.withColumn("_at", F.floor(hash_unit(seed + "-repeat", *[F.col(k) for k in keys], F.col("pick")) * F.col("_pool")) + 1)
    in_short = chunks.select(*keys, chunk).join(short.select(*keys), keys, "left_semi")
    numbered = position(in_short.withColumn("_h", hash_key(seed + "-pool", F.col(chunk))), keys, ["_h", chunk], F.substring("_h", 1, 2), "_at")
    second = draws.join(numbered.select(*keys, "_at", chunk), [*keys, "_at"]).select(*keys, chunk, "pick", F.lit(True).alias("repeated"))
    return first.unionByName(second)
