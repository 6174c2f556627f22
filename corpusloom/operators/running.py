"""Running aggregates inside groups of any size.

A plain window puts a whole group into one task. Here a group is cut into ordered blocks, each block is
reduced to one row, a window runs over those few rows only, and every block then continues from its own
start value. Rows are shuffled once, by (group, block), so a group holding a third of a table still spreads
over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum``, ``max`` or ``last`` (last non-null), up to and including the row."""

    kind: str
    value: Column


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Mapping[str, Running],
) -> DataFrame:
    """Add one column per entry of ``values``.

    ``block`` must be an order-preserving function of ``order``; its value decides the size of a task's share.
    """
    keys = list(keys)
    inputs = {f"_in_{name}": spec.value for name, spec in values.items()}
    rows = df.withColumn("_block", block).withColumns(inputs)

    position = F.struct(*[F.col(c) for c in order])
    reduced = []
    for name, spec in values.items():
        col = F.col(f"_in_{name}")
        if spec.kind == "sum":
            reduced.append(F.sum(col).alias(f"_b_{name}"))
        elif spec.kind == "max":
            reduced.append(F.max(col).alias(f"_b_{name}"))
        else:
            reduced.append(F.max_by(col, F.when(col.isNotNull(), position)).alias(f"_b_{name}"))
    blocks = rows.groupBy(*keys, "_block").agg(*reduced)

    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *keys,
        "_block",
        *[_fold(spec.kind, F.col(f"_b_{name}")).over(earlier).alias(f"_s_{name}") for name, spec in values.items()],
    )

    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(starts, [*keys, "_block"], "left")
    out = joined.withColumns(
        {
            name: _combine(spec.kind, F.col(f"_s_{name}"), _fold(spec.kind, F.col(f"_in_{name}")).over(inside))
            for name, spec in values.items()
        }
    )
    return out.select(*df.columns, *values.keys())


def _fold(kind: str, col: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "max":
        return F.max(col)
    return F.last(col, ignorenulls=True)


def _combine(kind: str, start: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(start, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(start, local)
    return F.coalesce(local, start)


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "position") -> DataFrame:
    """1-based position of each row in its group, for groups of any size. ``order`` must be unique in a group."""
    return running(df, keys, order, block, {name: Running("sum", F.lit(1).cast("long"))})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    ``n`` is a number known when the plan is made, so Spark cuts each task's rows to ``n`` per group before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def ranked_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, name: str = "rank") -> DataFrame:
    """``top_rows`` with an optional limit: without one every row of a group gets its rank."""
    if n is not None:
        return top_rows(df, keys, order, n, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
