"""Mixing sources to target weights: exact block quotas, split over output shards by a hypergeometric tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import hash_unit, let, record
from corpusloom.llm.columns import durable, global_running, word_count
from corpusloom.llm.risk_rules import _log_factorial as log_factorial

MOST_COPIES = 3
BLOCKS = 1024
SHARDS = 16
SEED = "mix"


def source_targets(sizes: DataFrame, weights: Column | None = None, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares by weight, none above ``most_copies`` times its size.

    Sources are numbered by code point, null last; ``weights`` is a column over that number (``place``, from 0) and by
    default 1, 2, 3, repeating. What a full source cannot take is shared by weight among the others until none is above;
    the level where that ends is found by running sums over sources in the order in which they fill up.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    each = durable(each)
    placed = global_running(each, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    weight = (1 + F.col("place") % 3) if weights is None else weights
    rows = placed.withColumn("weight", weight.cast("double")).withColumn("cap", (most_copies * F.col("source_size")).cast("double"))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    filled = global_running(rows, [F.col("full_at"), F.col("place")], {"caps": F.col("cap"), "weighed": F.col("weight")})
    level = (F.lit(float(total[0])) - F.col("caps")) / (F.lit(float(total[1])) - F.col("weighed"))
    ends = filled.withColumn("level", level).where(F.col("level") <= F.col("full_at"))
    found = ends.agg(F.min_by("level", F.struct("full_at", "place"))).first()[0]
    target = F.least(F.col("cap"), F.lit(float(found or 0.0)) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls out of ``total`` are among the ``good`` ones: the inverse of the exact distribution at ``u``.

    Only outcomes within twelve standard deviations are tabulated (the rest weighs less than a double can tell).
    """
    def limits(v: Column) -> Column:
        n, g, d = v["n"].cast("double"), v["g"].cast("double"), v["d"].cast("double")
        mean = F.when(n > 0, d * g / n).otherwise(0.0)
        spread = F.sqrt(F.when(n > 1, d * (g / n) * (1 - g / n) * (n - d) / (n - 1)).otherwise(0.0))
        return record(n=v["n"], g=v["g"], d=v["d"], mean=mean, reach=12 * spread + 1)

    def span(v: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), v["d"] - (v["n"] - v["g"]), F.floor(v["mean"] - v["reach"]))
        high = F.least(v["d"], v["g"], F.ceil(v["mean"] + v["reach"]))
        return record(n=v["n"], g=v["g"], d=v["d"], low=low, high=high, mid=F.least(F.greatest(F.floor(v["mean"]), low), high))

    def log_weight(v: Column, x: Column) -> Column:
        left = F.array(x, v["g"] - x, v["d"] - x, v["n"] - v["g"] - v["d"] + x)
        return -F.aggregate(F.transform(left, log_factorial), F.lit(0.0), lambda a, y: a + y)

    def draw(v: Column) -> Column:
        logs = F.transform(F.sequence(v["low"], v["high"]), lambda x: log_weight(v, x))
        weights = let(log_weight(v, v["mid"]), lambda top: F.transform(logs, lambda y: F.exp(y - top)))

        def below(w: Column) -> Column:
            whole = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
            start = record(sum=F.lit(0.0), n=F.lit(0).cast("long"))
            step = lambda a, x: record(sum=a["sum"] + x, n=a["n"] + (a["sum"] + x < u * whole).cast("long"))
            return F.aggregate(w, start, step)["n"]

        return F.least(v["low"] + let(weights, below), v["high"])

    given = record(n=total.cast("long"), g=good.cast("long"), d=drawn.cast("long"))
    return let(let(let(given, limits), span), draw)


def splitting_tree(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(source, bounds) from (source, quota): where each of ``shards`` shards ends in the source's row of drawn blocks.

    The tree halves the shards level by level. At a node the number of blocks that go left is fixed (in proportion to its
    shards), and which sources they come from is one multivariate hypergeometric draw: source by source, each draw
    conditioned on those before. So shards hold equal numbers of blocks, each source's quota is met exactly over all
    shards, and any shard mixes like the whole.
    """
    at = quotas.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("quota").cast("long").alias("q")))).alias("have"))
    nodes = at.select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "have")
    for _ in range(max(0, math.ceil(math.log2(max(shards, 1))))):
        nodes = nodes.select("first", "width", F.explode(_halves(seed)).alias("h")).select("h.*")
    each = nodes.select("first", F.explode("have").alias("e")).select("first", "e.s", "e.none", "e.q")
    before = Window.partitionBy("s", "none").orderBy("first")
    ends = each.withColumn("end", F.sum("q").over(before))
    out = ends.groupBy("s", "none").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "end"))), lambda x: x["end"]).alias("bounds"))
    return out.select(F.when(~F.col("none"), F.col("s")).alias("source"), "bounds")


def _halves(seed: str) -> Column:
    """The node's children as an array of (first, width, have); a leaf stays as it is."""
    width, first, have = F.col("width"), F.col("first"), F.col("have")
    left = F.ceil(width / 2).cast("int")
    total = F.aggregate(have, F.lit(0).cast("long"), lambda a, h: a + h["q"])

    def step(acc: Column, h: Column) -> Column:
        u = hash_unit(seed, first, width, h["s"], h["none"])

        def drawn(x: Column) -> Column:
            return record(total=acc["total"] - h["q"], draw=acc["draw"] - x, taken=F.concat(acc["taken"], F.array(x)))

        return let(hypergeometric(acc["total"], h["q"], acc["draw"], u), drawn)

    start = record(total=total, draw=F.floor(total * left / width), taken=F.array().cast("array<bigint>"))

    def children(taken: Column) -> Column:
        def child(at: Column, wide: Column, q) -> Column:
            sources = F.transform(have, lambda h, i: record(s=h["s"], none=h["none"], q=q(h, F.get(taken, i))))
            return record(first=at.cast("int"), width=wide.cast("int"), have=sources)

        return F.array(child(first, left, lambda h, t: t), child(first + left, width - left, lambda h, t: h["q"] - t))

    two = let(F.aggregate(have, start, step)["taken"], children)
    one = F.array(record(first=first.cast("int"), width=width.cast("int"), have=have))
    return F.when(width > 1, two).otherwise(one)


def _placed(docs: DataFrame, key: str, source: str, text: str, blocks: int, seed: str) -> DataFrame:
    """The row's size, its block of its source, and its place in the block's hashed order."""
    same = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    names = {"_source": F.col(source), "_size": word_count(F.col(text)), "_block": F.pmod(same, F.lit(blocks)).cast("int")}
    return docs.withColumns({**names, "_draw": F.xxhash64(F.lit(seed + " row"), F.col(key), F.col(text))})


def block_plan(
    rows: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, most_copies: int = MOST_COPIES, seed: str = SEED
) -> DataFrame:
    """Per source and block of the rows (_source, _size, _block, _draw): _whole, _edge, _last, _shards, and the source's numbers.

    A source is taken floor(target / size) times whole, and once more as far as its blocks, in hashed order, fit into
    the rest. Of the first block that no longer fits (``_edge``), the rows up to ``_last`` in hashed order come too, so
    that a source misses its target by half a document at most. Each copy of a block is one unit of the source's quota;
    the splitting tree deals the units, in hashed order and without overlap, to the shards.
    """
    targets = durable(source_targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size")), most_copies=most_copies))
    sums = rows.groupBy("_source", "_block").agg(F.sum("_size").alias("_sum"))
    joined = sums.join(targets, sums["_source"].eqNullSafe(targets["source"])).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    name = F.coalesce("_source", F.lit(""))
    order = Window.partitionBy("_source").orderBy(hash_unit(seed, name, F.col("_block")), "_block")
    sized = joined.withColumn("_whole", whole).withColumn("_room", F.col("target") - F.col("_whole") * F.col("source_size"))
    before = F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1))
    sized = sized.withColumn("_before", F.coalesce(before, F.lit(0)))
    fits = F.col("_before") + F.col("_sum") <= F.col("_room") + 1e-6
    edge = ~fits & (F.col("_before") < F.col("_room"))
    sized = sized.withColumn("_edge", edge).withColumn("_copies", F.col("_whole") + (fits | edge).cast("int"))
    sized = durable(sized)

    ends = sized.where("_edge").select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), (F.col("_room") - F.col("_before")).alias("_left"))
    held = rows.join(ends, rows["_source"].eqNullSafe(F.col("_s")) & (rows["_block"] == F.col("_b")))
    running = F.sum("_size").over(Window.partitionBy("_s", "_b").orderBy("_draw").rangeBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_mid", running - F.col("_size") / 2).where(F.col("_mid") <= F.col("_left"))
    last = held.groupBy(F.col("_s").alias("_source"), F.col("_b").alias("_block")).agg(F.max("_draw").alias("_last"))

    units = sized.where(F.col("_copies") > 0)
    units = units.select("_source", "_block", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    drawn = Window.partitionBy("_source").orderBy(hash_unit(seed + " draw", name, F.col("_block"), F.col("_copy")), "_block", "_copy")
    ranked = units.withColumn("_rank", F.row_number().over(drawn) - 1)
    quotas = units.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("quota"))
    bounds = splitting_tree(quotas, shards, seed)
    dealt = ranked.join(bounds, ranked["_source"].eqNullSafe(bounds["source"])).drop("source")
    dealt = dealt.withColumn("_shard", F.size(F.filter("bounds", lambda b: b <= F.col("_rank"))))
    units_of = dealt.groupBy("_source", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_copy", "_shard"))), lambda x: x["_shard"]).alias("_shards"))
    out = _with(_with(sized, last), units_of)
    none = F.array().cast("array<int>")
    return out.select("_source", "_block", "source_size", "target", "_whole", "_edge", "_last", F.coalesce("_shards", none).alias("_shards"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"_source": "_s", "_block": "_b"})
    return left.join(right, left["_source"].eqNullSafe(right["_s"]) & (left["_block"] == right["_b"]), "left").drop("_s", "_b")


def allotted(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, blocks: int = BLOCKS,
    most_copies: int = MOST_COPIES, seed: str = SEED,
) -> DataFrame:
    """``docs`` with _size (words of the whole text), source_size, target and _shards: the shard of each copy taken.

    Null or blank texts have size 0 and a null source is a source of its own (the last). Draws depend on the seed, the
    key and the text only, so reruns agree; rows alike in both are taken alike. Empty tables give empty results.
    """
    rows = _placed(docs, key, source, text, blocks, seed)
    narrow = durable(rows.select("_source", "_size", "_block", "_draw"))
    dealt = block_plan(narrow, shards, blocks, most_copies, seed)
    out = _with(rows.drop("source_size", "target"), dealt)
    extra = F.col("_edge") & (F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False)))
    copies = F.when(F.col("_edge"), F.col("_whole") + extra.cast("int")).otherwise(F.size("_shards"))
    return out.withColumn("_shards", F.slice("_shards", F.lit(1), copies)).drop("_source", "_block", "_draw", "_whole", "_edge", "_last")


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(key, size, source_size, target, taken) for each row: the words the mix takes of it, repeats counted."""
    narrow = docs.select(F.col(key).alias("_key"), F.col(source).alias("_from"), F.col(text).alias("_text"))
    rows = allotted(narrow, "_key", "_from", "_text", **options)
    words = (F.col("_size") * F.size("_shards")).cast("long")
    return rows.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", words.alias("taken"), F.col("_shards").alias("shards"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with copy (from 1) and shard (from 0), shuffled.

    Rows are dealt by shard and hash, so a shard of any size is many tasks, and each task sorts its rows by a hash: a
    shuffle inside the shard. Columns called copy or shard that ``docs`` had are replaced.
    """
    columns = [c for c in docs.columns if c not in ("copy", "shard")]
    rows = allotted(docs.select(*columns), key, source, text, seed=seed, **options)
    each = rows.select(*columns, F.posexplode("_shards").alias("copy", "shard")).withColumn("copy", F.col("copy") + 1)
    each = each.withColumn("_order", F.xxhash64(F.lit(seed + " order"), F.col(key), F.col("copy")))
    each = each.repartition("shard", F.pmod(F.col("_order"), F.lit(64)))
    return each.sortWithinPartitions("shard", "_order").drop("_order")
