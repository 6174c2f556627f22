"""Substring dedup by recompression: phrases named alike wherever they occur reveal long repeats, and windows verify them.

Texts are lists of words. Rounds name runs of equal words and then pairs of neighbouring symbols; a name is a hash of
what it stands for, so equal substrings get equal names in all documents without a dictionary. Which pairs are named in a
round depends on the two symbols alone (a bit of each name, and a bound on their joint length), so the inside of a
repeated stretch is cut alike at each of its occurrences. Each phrase carries the range of words that its cut depends
on; a phrase that occurs once in the corpus thus rules out every window that holds this range. Windows that no phrase
rules out are counted themselves, by 128-bit hashes. So the result is exact whatever the texts look like: phrases only
save work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.bytewords import Words, mixed, spans_hash, words

WINDOW = 35
ROUNDS = 6
#: Longest phrase in words. Phrases must be clearly shorter than the window to lie inside it.
PHRASE = 12
#: Text per group of documents that are handled together.
GROUP_BYTES = 2_000_000
_FAR = 1 << 40


def phrases(hashes: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS, longest: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high): the phrases of the last round, and the range of words that each depends on."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.ones(n, bool)
    opens[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(opens)
    end = np.append(start[1:], n)
    times = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        name = np.where(times > 1, mixed(hashes[start] + times * np.uint64(77), 9), hashes[start])
    doc = owner[start]
    near = np.zeros(len(start), bool)  # has a right neighbour in its text
    near[:-1] = doc[1:] == doc[:-1]
    low = np.where(np.append(False, near[:-1]), start - 1, -_FAR)
    high = np.where(near, end + 1, _FAR)
    size = end - start
    for k in range(rounds):
        left = (mixed(name, 100 + k) >> np.uint64(63)) == 0
        pair = near.copy()
        pair[:-1] &= left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= longest)
        second = np.append(False, pair[:-1])
        has_left = np.append(False, near[:-1])
        low_to, high_to, name_to, size_to = low.copy(), high.copy(), name.copy(), size.copy()
        i = np.flatnonzero(pair)
        low_to[i], high_to[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        size_to[i] += size[i + 1]
        with np.errstate(over="ignore"):
            name_to[i] = mixed(name[i] * np.uint64(3) + mixed(name[i + 1], 7), 200)
        # what stays single depends on the neighbour that it could have been paired with
        alone = ~pair & ~second & (size < longest)
        for i, have, step in ((np.flatnonzero(alone & left), near, 1), (np.flatnonzero(alone & ~left), has_left, -1)):
            edge, i = i[~have[i]], i[have[i]]
            if step > 0:
                high_to[edge] = _FAR
            else:
                low_to[edge] = -_FAR
            low_to[i], high_to[i] = np.minimum(low[i], low[i + step]), np.maximum(high[i], high[i + step])
        stays = ~second
        near_to = near.copy()
        i = np.flatnonzero(pair)
        near_to[i] = near[i + 1]
        name, size, low, high, near = (x[stays] for x in (name_to, size_to, low_to, high_to, near_to))
    return name, low, high


def _inner(found: Words, window: int, rounds: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases that a window can hold together with all they depend on."""
    name, low, high = phrases(found.hash, found.owner(), rounds, longest)
    fits = high - low <= window
    return name[fits], low[fits], high[fits]


def _starts(found: Words, window: int) -> np.ndarray:
    """True where a window of one text starts."""
    at = np.zeros(len(found.hash), bool)
    ends = np.repeat(found.first[1:], np.diff(found.first))
    at[np.arange(len(at)) + window <= ends] = True
    return at


def _candidates(found: Words, single: np.ndarray, window: int, rounds: int, longest: int) -> np.ndarray:
    """Starts of the windows that hold no phrase of ``single`` (sorted names that occur once) with what it depends on."""
    name, low, high = _inner(found, window, rounds, longest)
    once = _member(name, single)
    steps = np.zeros(len(found.hash) + 1, np.int64)
    steps += np.bincount(np.maximum(high[once] - window, 0), minlength=len(steps))
    steps -= np.bincount(low[once] + 1, minlength=len(steps))
    return np.flatnonzero(_starts(found, window) & (np.cumsum(steps)[:-1] == 0))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _places(found: Words) -> np.ndarray:
    """For each text the place of its first word in the group, whatever order the texts came in.

    Texts are placed by a hash of their words; texts that tie have the same words and may change places.
    """
    by = spans_hash(found.hash, found.first[:-1], found.first[1:])
    order = np.argsort(by, kind="stable")
    sizes = np.diff(found.first)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(sizes) - sizes
    return place


def _by_place(found: Words) -> np.ndarray:
    """The place in the group of every word."""
    return np.arange(len(found.hash)) + np.repeat(_places(found) - found.first[:-1], np.diff(found.first))


def _named(table: pa.Table, window: int, rounds: int, longest: int) -> pa.Table:
    """The phrases of a group with their numbers."""
    name, _, _ = _inner(words(table["text"]), window, rounds, longest)
    name, n = np.unique(name, return_counts=True)
    return pa.table({"name": name.view(np.int64), "part": _part(table, len(name)), "n": n})


def _part(table: pa.Table, n: int) -> np.ndarray:
    return np.full(n, table["part"][0].as_py() if len(table) else 0, np.int32)


def _windows(table: pa.Table, once: pa.Table, window: int, rounds: int, longest: int) -> pa.Table:
    """The candidate windows of a group with their numbers and a place, and the stretches they form.

    A stretch is told as a row of its own with minus its length as n and a key that no other row has.
    """
    found = words(table["text"])
    single = np.sort(once["name"].to_numpy().view(np.uint64))
    at = _candidates(found, single, window, rounds, longest)
    place = _by_place(found)[at]
    one, first, n = np.unique(spans_hash(found.hash, at, at + window, 1), return_index=True, return_counts=True)
    two = spans_hash(found.hash, at[first], at[first] + window, 2)
    owner = found.owner()[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(opens)
    length = np.diff(np.append(begin, len(at)))
    part = _part(table, len(one) + len(begin))
    key = mixed(place[begin].astype(np.uint64), 11)
    return pa.table({
        "one": np.concatenate([one, key]).view(np.int64),
        "two": np.concatenate([two.view(np.int64), -1 - part[len(one) :].astype(np.int64)]),
        "part": part,
        "place": np.concatenate([place[first], place[begin]]).astype(np.int64),
        "n": np.concatenate([n, -length]).astype(np.int64),
    })


def _cut(table: pa.Table, told: pa.Table, window: int, key_type: pa.DataType) -> pa.Table:
    """The texts of a group without what their repeated windows cover."""
    found = words(table["text"])
    n_words = len(found.hash)
    where = np.empty(n_words, np.int64)
    where[_by_place(found)] = np.arange(n_words)
    place, n = told["place"].to_numpy(), told["n"].to_numpy()
    long = n < 0
    steps = np.bincount(place[long], minlength=n_words + 1) - np.bincount(place[long] - n[long], minlength=n_words + 1)
    repeated = np.cumsum(steps)[:n_words] > 0
    repeated[place[~long]] = False
    at = where[np.flatnonzero(repeated)]
    steps = np.bincount(at, minlength=n_words + 1) - np.bincount(at + window, minlength=n_words + 1)
    stays = np.cumsum(steps)[:n_words] == 0
    kept, bounds = _joined(found, stays)
    removed = np.concatenate([[0], np.cumsum(~stays)])
    texts = pa.LargeStringArray.from_buffers(len(table), pa.py_buffer(bounds), pa.py_buffer(kept))
    return pa.table({
        "key": table["key"].combine_chunks().cast(key_type),
        "n_words": np.diff(found.first).astype(np.int64),
        "n_removed": np.diff(removed[found.first]).astype(np.int64),
        "kept_text": texts.cast(pa.string()) if len(kept) < 1 << 31 else texts,
    })


def _joined(found: Words, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words that stay, one blank between the words of a text, and where each text starts in them."""
    count = np.concatenate([[0], np.cumsum(stays)])
    left = np.repeat(count[found.first[1:]], np.diff(found.first)) - count[1:]  # words of the text that stay behind it
    end = found.end + (left > 0)  # the byte behind a word is the white space that follows it
    data = found.data.copy()
    data[found.end[stays & (left > 0)]] = 32
    steps = np.zeros(len(data) + 1, np.int8)
    steps[found.start[stays]] += 1
    steps[end[stays]] -= 1
    size = np.concatenate([[0], np.cumsum(np.where(stays, end - found.start, 0))])
    return data[np.cumsum(steps[:-1], dtype=np.int8) > 0], size[found.first].astype(np.int64)


def repeated_spans_removed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, longest: int = PHRASE, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(key, n_words, n_removed, kept_text): each text without the words inside any repeated window of ``window`` words.

    A window is repeated when its word sequence starts at any other place too, in the same or another text. Kept words are
    joined by one blank. Null, empty and blank texts have no words; texts shorter than a window keep all; repeated rows
    repeat each other; rows with a null key take part like others. Only ``key`` and ``text`` are read.

    Texts are dealt once, by hash, to groups of about ``group_bytes``; all three passes over them reuse that shuffle. A
    phrase or window moves as one row per group, however often it occurs in it, and is counted with a map-side sum: a
    passage in a third of all documents is one row per group, and no task ever holds its occurrences.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "text"), F.lit(total // group_bytes + 1)).cast("int"))
    key_type = to_arrow_type(rows.schema["key"].dataType)

    def named(table: pa.Table) -> pa.Table:
        return _named(table, window, rounds, longest)

    def windows(table: pa.Table, once: pa.Table) -> pa.Table:
        return _windows(table, once, window, rounds, longest)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        return _cut(table, told, window, key_type)

    names = rows.groupBy("part").applyInArrow(named, "name long, part int, n long")
    once = names.groupBy("name").agg(F.sum("n").alias("n"), F.min("part").alias("part")).where(F.col("n") == 1)
    found = rows.groupBy("part").cogroup(once.select("name", "part").groupBy("part")).applyInArrow(
        windows, "one long, two long, part int, place long, n long"
    )
    told = found.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("part").alias("part"), F.min("place").alias("place"))
    told = told.where(F.col("n") <= 1).select("part", "place", "n")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    out = rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(cut, schema)
    return out.withColumnRenamed("key", key)
