"""Removing benchmark passages: a broadcast hash set of test n-grams, probed by every window of the training texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import ascii_lower, durable, let, unused, window_keys

WINDOW = 10
#: Most test n-grams that go to the executors as a hash set (about 100 bytes each); beyond it windows are joined.
MOST_GRAMS = 50_000

# The characters between words, and those of words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

FOUND = "array<struct<at:int,length:int,gram:string>>"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of digits, ASCII letters and non-ASCII characters; none for a null text."""
    found = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS + "+"), "")
    return F.transform(found, ascii_lower)


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(length, gram, gram_key, items, nameless): every distinct word sequence that marks a test item, with the items that
    have it, and whether an item with a null key is among them.

    An item of fewer than ``window`` words is one shorter sequence; an item without words has none.
    """
    rows = items.select(F.col(key).cast("string").alias("_item"), item_words(F.col(text)).alias("_w"))
    rows = rows.where(F.size("_w") > 0).withColumn("length", F.least(F.size("_w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("length") + 1)
    grams = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("_w", i, F.col("length"))))
    rows = rows.select("_item", "length", F.explode(F.array_distinct(grams)).alias("gram"))
    hashes = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    by_length = F.coalesce(*[F.when(F.col("length") == n, F.get(window_keys(hashes, n), F.lit(0))) for n in range(1, window + 1)])
    held = [F.collect_set("_item").alias("items"), F.max(F.col("_item").isNull()).alias("nameless")]
    return rows.groupBy("length", "gram").agg(*held).withColumn("gram_key", by_length)


def _at(words: Column, at: Column, length: int) -> Column:
    gram = F.concat_ws(" ", F.slice(words, at + 1, F.lit(length)))
    return F.struct(at.alias("at"), F.lit(length).alias("length"), gram.alias("gram"))


def _probed(words: Column, known: dict[int, Callable[[Column], Column]], right: Callable[[Column], Column]) -> Column:
    """(n, found): the windows whose key is known and whose words are right."""

    def starts(hashes: Column, length: int) -> Column:
        def hits(keys: Column) -> Column:
            return F.filter(F.transform(keys, lambda k, i: F.when(known[length](k), i)), lambda i: i.isNotNull())

        return let(window_keys(hashes, length), hits)

    def of(w: Column) -> Column:
        def placed(length: int):
            return lambda i: _at(w, i, length)

        def windows(h: Column) -> Column:
            return F.concat(*[F.transform(starts(h, n), placed(n)) for n in known])

        found = F.filter(let(F.transform(w, lambda x: F.xxhash64(x)), windows), lambda f: right(f["gram"]))
        return F.struct(F.size(w).cast("long").alias("n"), found.alias("found"))

    return let(words, of)


def scanned(docs: DataFrame, grams: DataFrame, text: str = "text", most_grams: int = MOST_GRAMS) -> DataFrame:
    """``docs`` with _n_words and _found, the verified windows (at, length, gram) of every whole text.

    The test n-grams are counted first. Up to ``most_grams`` of them go to all tasks as a hash set of keys, and each hit
    is verified in place against the words themselves: one pass over the texts, no shuffle. With more, the windows' keys
    are shuffled to the keys of the test n-grams, and the hits are verified by a join on the words. The rows are the
    same either way.
    """
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # at most WINDOW rows
    words = item_words(F.col(text))
    if not lengths:
        return docs.withColumns({"_n_words": F.size(words).cast("long"), "_found": F.array().cast(FOUND)})
    if grams.count() > most_grams:
        return _joined(docs, grams, lengths, words)
    listed = grams.select("length", "gram", "gram_key").collect()  # bounded by most_grams
    sets = {n: [r["gram_key"] for r in listed if r["length"] == n] for n in lengths}
    known = {n: (lambda k, v=tuple(v): k.isin(*v)) for n, v in sets.items()}
    texts = tuple(r["gram"] for r in listed)
    rows = docs.withColumn("_told", _probed(words, known, lambda g: g.isin(*texts)))
    return rows.withColumns({"_n_words": F.col("_told.n"), "_found": F.col("_told.found")}).drop("_told")


def _joined(docs: DataFrame, grams: DataFrame, lengths: list[int], words: Column) -> DataFrame:
    rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()))
    hashed = rows.select("_row", F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    each = None
    for n in lengths:
        part = hashed.select("_row", F.lit(n).alias("length"), F.posexplode(window_keys(F.col("_h"), n)).alias("at", "gram_key"))
        each = part if each is None else each.unionByName(part)
    hits = each.join(grams.select("length", "gram_key").distinct(), ["length", "gram_key"], "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_set(F.struct("at", "length")).alias("_hits"))  # at most one per window
    held = rows.join(hits, "_row").withColumn("_w", words)
    told = F.transform("_hits", lambda f: F.struct(f["at"].alias("at"), f["length"].alias("length"), F.concat_ws(" ", F.slice("_w", f["at"] + 1, f["length"])).alias("gram")))
    told = held.select("_row", F.explode(told).alias("_f")).select("_row", "_f.*")
    right = told.join(grams.select("length", "gram"), ["length", "gram"], "left_semi")
    found = right.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "length", "gram"))).alias("_found"))
    out = rows.join(found, "_row", "left").withColumn("_n_words", F.size(words).cast("long"))
    return out.withColumn("_found", F.coalesce("_found", F.array().cast(FOUND))).drop("_row")


def union_length(spans: Column) -> Column:
    """How many positions the (at, length) spans cover together, whatever their order."""

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["length"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(spans), start, step)["n"].cast("long")


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, n_hit (words inside found windows), items (sorted item keys), n_items.

    Items with a null key hit like others; they have no place in ``items``, but count as one in ``n_items``. Null texts have no words; rows with a null key and repeated rows are kept and judged one by one; empty tables and a
    benchmark without words give no hits. Only ``key`` and the text are read, so other columns may have any name.
    """
    grams = durable(benchmark_windows(items, item_key))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = scanned(rows, grams, "_text", most_grams)
    grams_of = F.array_distinct(F.transform("_found", lambda f: f["gram"]))
    rows = durable(rows.select("_key", F.xxhash64("_text").alias("_same"), "_n_words", union_length(F.col("_found")).alias("_n_hit"), grams_of.alias("_grams")))
    each = rows.where(F.col("_n_hit") > 0).select("_key", "_same", F.explode("_grams").alias("gram"))
    each = each.join(grams.select("gram", "nameless", F.explode_outer("items").alias("_item")), "gram")
    found = each.groupBy(F.col("_key").alias("_k"), F.col("_same").alias("_s"))
    found = found.agg(F.array_sort(F.collect_set("_item")).alias("items"), F.max(F.col("nameless").cast("long")).alias("_nameless"))  # at most all test items
    out = rows.join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_same") == F.col("_s")), "left")
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    n_items = (F.size(listed) + F.coalesce("_nameless", F.lit(0))).cast("long")
    return out.select(F.col("_key").alias(key), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), listed.alias("items"), n_items.alias("n_items"))


def cleaned(docs: DataFrame, items: DataFrame, remove: str = "documents", text: str = "text", item_key: str = "item_id", most_grams: int = MOST_GRAMS) -> DataFrame:
    """``docs`` with its columns, without contaminated documents (``documents``) or without the hit words (``spans``).

    With ``spans`` a hit word goes together with the separators before it, everything else stays as it is. Null and
    empty texts stay.
    """
    grams = durable(benchmark_windows(items, item_key))
    rows = scanned(docs, grams, text, most_grams)
    if remove == "documents":
        return rows.where(F.size("_found") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({SEPARATORS}*{LETTERS}+)"), F.lit(1))
    inside = unused(rows, "_inside")
    at = F.array_distinct(F.flatten(F.transform("_found", lambda f: F.sequence(f["at"], f["at"] + f["length"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(inside))
    left = F.concat(F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""), F.regexp_extract(F.col(text), f"({SEPARATORS}*)$", 1))
    new = F.when(F.size("_found") == 0, F.col(text)).otherwise(left)
    return rows.withColumn(inside, at).withColumn(text, new).select(*docs.columns)
