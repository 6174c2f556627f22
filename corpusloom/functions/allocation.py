"""Count allocation over the four query types, inside one row.

Counts, shares and flags are arrays in the order of ``QUERY_TYPES``; no shuffle is needed to allocate a batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.querytype import QUERY_TYPES
from corpusloom.functions.text import let, record

# Distribution profiles, and where an unavailable type's count may go.
PROFILES = {"balanced": (0.25, 0.25, 0.25, 0.25), "multihop_focus": (0.10, 0.10, 0.40, 0.40)}
PREFERENCE = {
    "multi_hop_abstract": ("multi_hop_specific", "single_hop_abstract", "single_hop_specific"),
    "multi_hop_specific": ("single_hop_specific", "single_hop_abstract"),
    "single_hop_abstract": ("single_hop_specific",),
    "single_hop_specific": (),
}
PLACE = {name: i for i, name in enumerate(QUERY_TYPES)}


def profile(name: str) -> Column:
    return F.array(*[F.lit(x) for x in PROFILES[name]])


def normalized(raw: Column) -> Column:
    """Shares from an array of texts: unreadable, negative and NaN count as 0; an empty sum gives the default profile."""
    usable = F.transform(raw, lambda x: F.greatest(F.coalesce(F.nanvl(x.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))

    def share(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(values, lambda x: x / total)).otherwise(profile("multihop_focus"))

    return let(usable, share)


def resolved(given_json: Column, given_file: Column, profile_name: str) -> Column:
    """Stated distribution by precedence: json, then file, then profile; a source that is null is passed over."""
    stated = [F.when(given.isNotNull(), normalized(given)) for given in (given_json, given_file)]
    return F.coalesce(*stated, profile(profile_name))


def allocate(total: Column, shares: Column) -> Column:
    """Largest remainders; equal remainders go to the earlier type."""
    exact = F.transform(shares, lambda s: F.greatest(total, F.lit(0)) * s)

    def spread(values: Column) -> Column:
        base = F.transform(values, lambda x: F.floor(x).cast("int"))
        rest = F.transform(values, lambda x: x - F.floor(x))
        left = F.greatest(total, F.lit(0)) - F.aggregate(base, F.lit(0), lambda a, x: a + x)
        whole = record(base=base, rest=rest, left=left)

        def extra(s: Column) -> Column:
            ahead = lambda r, i: F.size(F.filter(s["rest"], lambda x, j: (x > r) | ((x == r) & (j < i))))
            return F.transform(s["base"], lambda b, i: b + (ahead(F.get(s["rest"], i), i) < s["left"]).cast("int"))

        return let(whole, extra)

    return let(exact, spread)


def available_types(parents: Column, chunks: Column, files: Column, multi_file: bool = False) -> Column:
    """Which types a batch can serve."""
    enough_files = (files >= 2) if multi_file else F.lit(True)
    specific = (parents >= 2) & (chunks >= 2) & enough_files
    abstract = (parents >= 2) & (chunks >= 3) & enough_files
    return F.array(F.lit(True), F.lit(True), specific, abstract)


def unavailable_reason(available: Column) -> Column:
    """Reason per type, null where available."""
    reasons = F.array(F.lit(None), F.lit(None), F.lit("insufficient_multihop_evidence"), F.lit("insufficient_multihop_cluster_signals"))
    return F.transform(reasons, lambda r, i: F.when(~F.get(available, i), r))


def moves(counts: Column, available: Column, prefix: str = "") -> Column:
    """One (source, target, moved, reason) per unavailable type with a count; target null where nothing is available."""
    alphabetical = sorted(QUERY_TYPES)
    rows = []
    for source in QUERY_TYPES:
        preferred = F.coalesce(*[F.when(F.get(available, F.lit(PLACE[t])), F.lit(t)) for t in PREFERENCE[source]]) if PREFERENCE[source] else F.lit(None).cast("string")
        anything = F.coalesce(*[F.when(F.get(available, F.lit(PLACE[t])), F.lit(t)) for t in alphabetical])
        count = F.get(counts, F.lit(PLACE[source]))
        reason = F.when(preferred.isNotNull(), prefix + "unavailable_for_batch").when(anything.isNotNull(), prefix + "fallback_to_any_available_type").otherwise(prefix + "nothing_available")
        row = F.struct(F.lit(source).alias("source"), F.coalesce(preferred, anything).alias("target"), count.alias("moved"), reason.alias("reason"))
        rows.append(F.when(~F.get(available, F.lit(PLACE[source])) & (count > 0), row))
    return F.array_compact(F.array(*rows))


def moved_counts(counts: Column, available: Column, events: Column) -> Column:
    """Counts after the moves."""
    kept = lambda i: F.when(F.get(available, F.lit(i)), F.greatest(F.get(counts, F.lit(i)), F.lit(0))).otherwise(0)
    gained = lambda name: F.aggregate(
        F.filter(events, lambda e: e["target"] == name), F.lit(0), lambda a, e: a + e["moved"]
    )
    return F.array(*[kept(i) + gained(name) for i, name in enumerate(QUERY_TYPES)])
