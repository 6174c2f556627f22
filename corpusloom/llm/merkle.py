"""Merkle manifest of a dataset: a digest that stands for every row, and for each row a proof that it is part of it.

Rows of a group are leaves in the order of their keys. Runs of ``FANOUT`` neighbouring nodes have one parent, level by
level, until one node is left; the groups' last nodes are the leaves of one more tree. Builders take aligned blocks of
``BLOCK`` nodes, so that all runs inside a block are whole, and write the nodes in the order in which they are complete
(postorder). How many nodes lie below a node tells its position there, so proofs read siblings by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import record
from corpusloom.llm.columns import durable, let

FANOUT = 16
#: Levels that a builder adds at once, and the nodes it starts from.
HEIGHT = 2
BLOCK = FANOUT**HEIGHT


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of the fields of a row."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def levels_above(n: Column) -> Column:
    """Levels above ``n`` nodes up to the one that is left."""
    return sum((F.when(n > FANOUT**m, 1).otherwise(0) for m in range(1, 15)), F.when(n > 1, 1).otherwise(0))


def nodes_on(n: Column, level: int) -> Column:
    """Nodes on a level above ``n`` nodes."""
    return _div(n + (FANOUT**level - 1), FANOUT**level)


def postorder(level: int, index: Column, n: Column) -> Column:
    """Position, from 0, of a node in the order of completion of a tree over ``n`` nodes.

    Up to and with the node itself come all nodes over the same leaves or earlier ones, and of the higher levels those
    that were full before it.
    """
    below = sum((F.least((index + 1) * FANOUT ** (level - m), nodes_on(n, m)) for m in range(level + 1)), F.lit(0))
    return below + sum((_div(index, FANOUT ** (m - level)) for m in range(level + 1, HEIGHT + 1)), F.lit(0)) - 1


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``index``, the place from 0 in their group, and ``n``, the size of the group.

    Rows are dealt by range of group and order and sorted once, whatever the sizes of the groups; of each range only the
    groups' counts meet.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = durable(dealt.withColumn("_at", F.monotonically_increasing_id()))  # range, then place in it
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    parts = dealt.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(parts.select(
        F.col(group).alias("_group"), F.col("_range").alias("_r"), F.col("_first").alias("first"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"), F.sum("_n").over(whole).alias("n"),
    ))
    joined = dealt.join(starts, (dealt["_range"] == starts["_r"]) & dealt[group].eqNullSafe(starts["_group"]))
    return joined.select(*rows.columns, (F.col("_at") - F.col("first") + F.col("before")).alias("index"), "n")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(runs, lambda start: F.sha2(F.array_join(F.slice(nodes, start, FANOUT), ""), 256))


def logs(nodes: DataFrame, rest: Sequence[str] = ()) -> DataFrame:
    """One row per block of (group, index, n, digest) with the block's nodes up to ``HEIGHT`` levels in postorder.

    Columns: group, block, n, levels (those this block adds), log (array of digests), nodes (the columns ``rest`` of the
    block's own nodes, in order). Less than ``HEIGHT`` levels are added where the group's last node comes before.
    """
    rows = nodes.select("group", "n", "index", _div(F.col("index"), BLOCK).alias("block"), "digest", *rest)
    taken = F.sort_array(F.collect_list(F.struct("index", "digest", *rest))).alias("nodes")
    blocks = rows.groupBy("group", "block", "n").agg(taken)
    blocks = blocks.withColumn("levels", F.least(levels_above(F.col("n")), F.lit(HEIGHT)))

    def placed(level: int, nodes: Column, count: Column) -> Column:
        last = lambda j: F.least((j + 1) * FANOUT**level, count)
        return F.transform(nodes, lambda digest, j: record(leaf=last(j), level=F.lit(level), digest=digest))

    def order(levels: list[Column], count: Column) -> Column:
        done = [placed(level, nodes, count) for level, nodes in enumerate(levels)]
        return F.transform(F.sort_array(F.concat(*done)), lambda node: node["digest"])

    none = F.array().cast("array<string>")

    def built(levels: list[Column]) -> Column:
        if len(levels) > HEIGHT:
            return order(levels, F.size(levels[0]))
        above = F.when(F.col("levels") >= len(levels), _parents(levels[-1])).otherwise(none)
        return let(above, lambda made: built([*levels, made]))

    log = let(F.transform("nodes", lambda x: x["digest"]), lambda leaves: built([leaves]))
    return durable(blocks.withColumn("log", log))


def _joined(log: Column, n: Column, level: int, first: Column, last: Column) -> Column:
    """The digests of neighbouring nodes of a level, read from the log by position."""
    read = F.transform(F.sequence(first, last), lambda i: F.get(log, postorder(level, i, n).cast("int")))
    return F.when(first <= last, F.array_join(read, "")).otherwise("")


def _siblings(log: Column, n: Column, index: Column, levels: Column) -> Column:
    """For each level of a block the digests left and right of the way from node ``index`` up, as array of (left, right)."""
    steps = []
    for level in range(HEIGHT):
        at = _div(index, FANOUT**level)
        first = at - at % FANOUT
        last = F.least(first + FANOUT, nodes_on(n, level)) - 1
        steps.append(record(left=_joined(log, n, level, first, at - 1), right=_joined(log, n, level, at + 1, last)))
    return F.slice(F.array(*steps), F.lit(1), levels)


PATH = "array<struct<left:string,right:string>>"


def _trees(leaves: DataFrame, rest: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """The logs of all rounds, and (group, digest) of the last node of each group."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, tops, nodes, carried = [], [], leaves, rest
    while True:
        made = logs(nodes, carried)
        rounds.append(made)
        roots = made.select("group", F.col("block").alias("index"), "n", F.element_at("log", -1).alias("digest"))
        tops.append(roots.where(F.col("n") <= BLOCK).select("group", "digest"))
        if most <= BLOCK:
            break
        nodes, carried = roots.where(F.col("n") > BLOCK).withColumn("n", nodes_on(F.col("n"), HEIGHT)), ()
        most = -(-most // BLOCK)
    top = tops[0]
    for other in tops[1:]:
        top = top.unionByName(other)
    return rounds, top


def _paths(rounds: Sequence[DataFrame], tops: DataFrame, made) -> DataFrame:
    """``made(node, path)`` as columns for each node of the first round. ``tops``: (group, path, more…) of the groups' last nodes.

    Rounds are joined from the last to the first, a row per block, so that only paths of blocks move.
    """
    more = [c for c in tops.columns if c not in ("group", "path")]
    finished = tops.withColumns({"block": F.lit(0).cast("long"), "last": F.lit(True)})
    above = finished
    for number in range(len(rounds) - 1, -1, -1):
        right = above.select(F.col("group").alias("_g"), F.col("block").alias("_b"), "last", F.col("path").alias("_above"), *more)
        same = F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")) & ((F.col("n") <= BLOCK) == F.col("last"))
        rows = rounds[number].join(right, same)
        size = F.size("nodes").cast("long")

        def path(place: Column) -> Column:
            return F.concat(_siblings(F.col("log"), size, place, F.col("levels")), F.col("_above"))

        if number == 0:
            each = F.transform("nodes", lambda node, i: let(path(i.cast("long")), lambda way: made(node, way)))
            return rows.select("group", *more, F.explode(each).alias("row")).select("group", *more, "row.*")
        each = F.transform("nodes", lambda node, i: record(block=node["index"], path=path(i.cast("long"))))
        below = rows.select("group", *more, F.explode(each).alias("row")).select("group", "row.block", "row.path", F.lit(False).alias("last"), *more)
        above = below.unionByName(finished.select(*below.columns))
    raise AssertionError("no rounds")


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its way give."""
    return F.aggregate(path, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proofs(docs: DataFrame, leaf: Column, shown: Column, key: str = "doc_id", group: str = "source") -> DataFrame:
    """For each row its leaf, its group's and the dataset's root, a digest of its proof, and whether ``shown`` passes it.

    ``leaf`` is the digest the manifest is built from, ``shown`` the one that is checked (null: the leaf itself). Columns:
    key, group, leaf, subroot, root, n_siblings, proof_sha256, folded_root, verified.

    Rows with equal keys are leaves of their own, in the order of their digests; null keys come first; a null group is a
    group of its own, the first. Groups are ordered bytewise. A table without rows gives none. Other columns of ``docs``
    play no part, so their names may clash with any of these.
    """
    rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"), shown.alias("shown"))
    rounds, tops = _trees(numbered(rows, "group", ["key", "digest"]), ["key", "shown"])
    groups = tops.select(F.lit(0).alias("group"), F.col("group").alias("name"), "digest")
    top_rounds, top = _trees(numbered(groups, "group", ["name"]), ["name"])
    start = top.select("group", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    found = _paths(top_rounds, start, lambda node, way: record(name=node["name"], subroot=node["digest"], path=way))
    found = durable(found.select(F.col("name").alias("group"), "path", "subroot", "root"))

    def checked(node: Column, way: Column) -> Column:
        both = F.transform(way, lambda step: F.concat(step["left"], step["right"]))
        return let(F.array_join(both, ""), lambda proof: record(
            key=node["key"], leaf=node["digest"], n_siblings=_div(F.length(proof), 64),
            proof_sha256=F.sha2(proof, 256), folded_root=folded(F.coalesce(node["shown"], node["digest"]), way),
        ))

    out = _paths(rounds, found, checked)
    return out.select(
        F.col("key").alias(key), F.col("group").alias(group), "leaf", "subroot", "root", "n_siblings", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
