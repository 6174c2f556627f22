"""Retrieval metrics over arrays of ranked ids. Null means "no reference, not applicable"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default depths.
K_VALUES = (1, 3, 5, 8)


def _judged(refs: Column, value: Column) -> Column:
    return F.when(F.size(F.coalesce(refs, F.array())) > 0, value)


def _top(ids: Column, k: int) -> Column:
    return F.slice(ids, 1, k)


def _hits(ids: Column, refs: Column, k: int) -> Column:
    return F.size(F.filter(_top(ids, k), lambda x: F.array_contains(refs, x)))


def precision_at(ids: Column, refs: Column, k: int) -> Column:
    """Hits over the number of returned ids; 0 where nothing came back."""
    returned = F.size(_top(ids, k))
    return _judged(refs, F.when(returned > 0, _hits(ids, refs, k) / returned).otherwise(0.0))


def recall_at(ids: Column, refs: Column, k: int) -> Column:
    found = F.size(F.array_intersect(F.array_distinct(refs), _top(ids, k)))
    return _judged(refs, found / F.size(F.array_distinct(refs)))


def hit_at(ids: Column, refs: Column, k: int) -> Column:
    return _judged(refs, (_hits(ids, refs, k) > 0).cast("double"))


def mrr_at(ids: Column, refs: Column, k: int) -> Column:
    places = F.transform(_top(ids, k), lambda x, i: F.when(F.array_contains(refs, x), i + 1))
    return _judged(refs, F.coalesce(1.0 / F.array_min(places), F.lit(0.0)))


def ndcg_at(ids: Column, refs: Column, k: int) -> Column:
    gains = F.transform(
        _top(ids, k), lambda x, i: F.when(F.array_contains(refs, x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0)
    )
    got = F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)
    ideal_places = F.sequence(F.lit(1), F.least(F.size(refs), F.lit(k)))
    ideal = F.aggregate(ideal_places, F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0)))
    return _judged(refs, F.when(ideal > 0, got / ideal).otherwise(0.0))


METRICS = {"precision": precision_at, "recall": recall_at, "hit": hit_at, "mrr": mrr_at, "ndcg": ndcg_at}


def all_metrics(ids: Column, refs: Column, k_values=K_VALUES) -> dict[str, Column]:
    """Every metric at every depth, named like ``recall_at_5``."""
    return {f"{name}_at_{k}": F.round(fn(ids, refs, k), 6) for name, fn in METRICS.items() for k in k_values}
