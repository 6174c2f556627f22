"""Byte-level BPE: Spark cuts texts into words, Arrow batches fold the bytes of their distinct words by ranked merges.

A vocabulary gives every piece of bytes a rank, which is also its id. Two neighbouring pieces can be joined if their
joint bytes are a piece; the pair with the lowest rank is joined first, the leftmost of several.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import slices

# Fixed value: the published pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAME_MATCHES = r""" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie; a parameter everywhere.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct words that are folded at a time.
AT_ONCE = 1 << 15
#: Longer words (in bytes) are folded one by one, with a heap.
LONGEST = 64
#: The texts of a batch are encoded in parts of about this many bytes.
PART = 1 << 23

#: Bits of an id or rank; the highest rank stands for "no piece".
BITS = 18
NONE = (1 << BITS) - 1
#: Bits of a hash that choose the group of a pair.
GROUP_BITS = 15


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a rank file with their ranks."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    if max(ranks.values(), default=0) >= NONE:
        raise ValueError(f"ranks must be below {NONE}")
    return ranks


@dataclass(frozen=True)
class RankMap:
    """The ranks of all pairs of pieces, those of two bytes also by the bytes themselves, and the pieces by id.

    A pair's key and the rank of its joint bytes share one number in ``entries``. Its place there is its key's hash with
    the mask of the hash's group, so one look-up tells whether a pair has a rank.
    """

    salt: int
    entries: np.ndarray
    masks: np.ndarray
    singles: np.ndarray
    doubles: np.ndarray
    pieces: pa.Array

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of joined ids, or ``NONE``."""
        key = (left.astype(np.int64) << BITS) | right
        hashed = _hashes(key | self.salt)
        place = ((hashed >> GROUP_BITS) ^ self.masks[hashed & (len(self.masks) - 1)]) & (len(self.entries) - 1)
        entry = self.entries[place]
        return np.where(entry >> BITS == key, entry & NONE, NONE).astype(np.int32)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair by its key."""
        used = self.entries[self.entries >= 0]
        return dict(zip((used >> BITS).tolist(), (used & NONE).tolist()))


def _hashes(keys: np.ndarray) -> np.ndarray:
    """Murmur 3 of whole numbers (32 bits, seed 42, as Spark's ``hash``), without the sign."""
    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    # The constants of the published hash function.
    h = np.full(len(keys), 42, np.uint32)
    for word in (keys & 0xFFFFFFFF, keys >> 32):
        h = turned(h ^ turned(word.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int64)


def _places(keys: np.ndarray) -> tuple[int, int, list[int], np.ndarray]:
    """salt, size, mask of each group, and the place of each key, no two the same.

    The salt, bits above those of the keys, is the first with which all hashes differ. The lower bits of a hash are its
    group, the upper bits with the group's mask its place. Groups choose their mask in order of size, each the first that
    fits; if none fits, there are more places.
    """
    groups, size = 1 << GROUP_BITS, 1 << max(2 * len(keys), 2).bit_length()
    salt = next(s << 2 * BITS for s in range(1 << 20) if len(np.unique(_hashes(keys | (s << 2 * BITS)))) == len(keys))
    hashes = _hashes(keys | salt)
    group = hashes % groups
    order = np.lexsort((group, -np.bincount(group, minlength=groups)[group]))
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    while True:
        base = (hashes >> GROUP_BITS) % size
        taken, masks, places = bytearray(size), [0] * groups, np.zeros(len(keys), np.int64)
        for members in np.split(order, cuts[1:]) if len(order) else []:
            wanted = base[members].tolist()
            mask = None
            if len(set(wanted)) == len(wanted):
                mask = next((m for m in range(size) if not any(taken[w ^ m] for w in wanted)), None)
            if mask is None:
                break
            for member, w in zip(members, wanted):
                places[member] = w ^ mask
                taken[w ^ mask] = 1
            masks[int(group[members[0]])] = mask
        else:
            return salt, size, masks, places
        size *= 2


def rank_map(ranks: Mapping[bytes, int]) -> RankMap:
    """The look-up arrays for a vocabulary: pairs, ids of the 256 single bytes, and pieces by id."""
    pairs = [
        (((ranks[piece[:i]] << BITS) | ranks[piece[i:]]), rank)
        for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks
    ]
    salt, size, masks, places = _places(np.array([key for key, _ in pairs], np.int64))
    entries = np.full(size, -1, np.int64)
    entries[places] = [(key << BITS) | rank for key, rank in pairs]
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    singles = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    doubles = np.array([ranks.get(bytes([b, c]), NONE) for b in range(256) for c in range(256)], np.int32)
    return RankMap(salt, entries, np.array(masks, np.int64), singles, doubles, pa.array(pieces, pa.large_binary()))


def words(text: Column, pattern: str = PATTERN) -> Column:
    """The matches of ``pattern`` in order, with the classes of Unicode; a null text has none.

    In the published pattern the parts that most words match come first here; no two of the parts moved match at the
    same place.
    """
    if pattern == PATTERN:
        pattern = SAME_MATCHES
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), 0)


def _folded(codes: np.ndarray, sizes: np.ndarray, table: RankMap) -> tuple[np.ndarray, np.ndarray]:
    """The ids left of words (a row of bytes each) when no neighbours can be joined any more, and their numbers.

    A step joins the pair with the lowest rank, the leftmost of several, of every word that still has one.
    """
    ids, sizes = table.singles[codes], sizes.copy()
    out, left, row = ids.copy(), sizes.copy(), np.arange(len(ids))
    ranks = table.doubles[codes[:, :-1].astype(np.int32) << 8 | codes[:, 1:]]
    ranks[np.arange(ranks.shape[1]) >= sizes[:, None] - 1] = NONE
    while ranks.shape[1] and len(row):
        low = ranks.argmin(axis=1)
        best = ranks[np.arange(len(row)), low]
        more = best < NONE
        if not more.all():
            done = row[~more]
            out[done, : ids.shape[1]], left[done] = ids[~more], sizes[~more]
            ids, ranks, sizes, row, low, best = ids[more], ranks[more], sizes[more], row[more], low[more], best[more]
            if not len(row):
                break
        sizes -= 1
        width, every = int(sizes.max()), np.arange(len(row))
        ids = np.where(np.arange(width) > low[:, None], ids[:, 1 : width + 1], ids[:, :width])
        ids[every, low] = best
        last = np.full((len(row), 1), NONE, np.int32)
        ranks = np.where(np.arange(width) > low[:, None], np.hstack([ranks[:, 1:], last])[:, :width], ranks[:, :width])
        ranks[every, low] = NONE
        some = np.flatnonzero(low < sizes - 1)
        ranks[some, low[some]] = table.rank(best[some], ids[some, low[some] + 1])
        some = np.flatnonzero(low > 0)
        ranks[some, low[some] - 1] = table.rank(ids[some, low[some] - 1], best[some])
        ranks = ranks[:, : max(width - 1, 0)]
    out[row, : ids.shape[1]], left[row] = ids, sizes
    return out, left


def _folded_long(word: bytes, table: RankMap) -> list[int]:
    """The ids left of one word; a heap holds the pairs, so that its cost hardly grows faster than the word."""
    ids = table.singles[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int]] = []

    def add(i: int, j: int) -> None:
        if i >= 0 and j < len(ids):
            key = ids[i] << BITS | ids[j]
            if (rank := table.pairs.get(key)) is not None:
                heapq.heappush(heap, (rank, i, key))

    for i in range(len(ids) - 1):
        add(i, i + 1)
    while heap:
        rank, i, key = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= len(ids) or ids[i] << BITS | ids[j] != key:
            continue  # one of the pair has been joined since
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        add(before[i], i)
        add(i, after[i])
    return [x for x in ids if x >= 0]


def _blocks(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of words of at most ``LONGEST`` bytes, up to ``most`` at a time, whose sizes differ by a factor of two at most."""
    order = np.argsort(sizes, kind="stable")
    cuts = [0, *np.searchsorted(sizes[order], 2 ** np.arange(LONGEST.bit_length()), "right")]
    for low, high in zip(cuts, cuts[1:]):
        for at in range(low, high, max(most, 1)):
            yield order[at : min(high, at + max(most, 1))]


def word_ids(words: pa.Array, table: RankMap, most: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words one after the other, and the number of each word's ids. A word that is a piece is its id."""
    words = words.cast(pa.large_binary())
    piece = pc.index_in(words, value_set=table.pieces, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
    counts = np.ones(len(words), np.int64)
    rest = np.flatnonzero(piece < 0)
    folded = words.take(pa.array(rest))
    offsets = np.frombuffer(folded.buffers()[1], np.int64)[folded.offset : folded.offset + len(folded) + 1] if len(folded) else np.zeros(1, np.int64)
    data, sizes = np.frombuffer(folded.buffers()[2] or b"", np.uint8), np.diff(offsets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their numbers of ids, ids
    for some in _blocks(sizes, most):
        if len(some):
            at = offsets[some][:, None] + np.arange(int(sizes[some].max()))
            ids, left = _folded(data[np.minimum(at, len(data) - 1)], sizes[some], table)
            found.append((rest[some], left, ids[np.arange(ids.shape[1]) < left[:, None]]))
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        ids = np.array(_folded_long(data[offsets[i] : offsets[i + 1]].tobytes(), table), np.int32)
        found.append((rest[i : i + 1], np.array([len(ids)]), ids))
    for some, left, _ in found:
        counts[some] = left
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    whole = np.flatnonzero(piece >= 0)
    out[ends[whole] - 1] = piece[whole]
    for some, left, ids in found:
        out[_spread(ends[some] - left, left)] = ids
    return out, counts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i]``, ``starts[i] + 1`` … of each i, ``counts[i]`` of them, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _encoded(rows: pa.Array, table: RankMap, most: int) -> pa.Array:
    """Lists of ids for lists of words: each distinct word is encoded once."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = rows.flatten().dictionary_encode()
    ids, counts = word_ids(coded.dictionary, table, most)
    starts, at = np.cumsum(counts) - counts, coded.indices.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts[at])])[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[_spread(starts[at], counts[at])]))


def encoded(
    docs: DataFrame, ranks: Mapping[bytes, int], text: str = "text", ids: str = "ids", pattern: str = PATTERN, most: int = AT_ONCE, table: RankMap | None = None
) -> DataFrame:
    """``docs`` with an array of the token ids of the whole text, as the ``tiktoken`` library encodes ordinary text.

    Texts are cut into words by Spark and go in Arrow batches to the tasks' Python, where the distinct words of a part
    of a batch are folded together, up to ``most`` at a time. No text is shuffled, no word is a hot key, and nothing of
    the table comes to the driver. A null or empty text has no ids. Rows are handled one by one: repeated rows and null
    keys stay as they are. A column called like ``ids`` is replaced. White space, letters and numbers are those of the
    Unicode version of the Java runtime.
    """
    table = table or rank_map(ranks)

    @F.arrow_udf("array<int>")
    def ids_of(rows: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        size = rows.flatten().nbytes // max(int(sizes.sum()), 1) + 1  # bytes a word, about
        parts = [_encoded(rows[low:high], table, most) for low, high in slices(sizes * size, PART)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, ids_of(words(F.col(text), pattern)))


def decoded(ids: Column, table: RankMap) -> Column:
    """The bytes of an array of ids: their pieces one after the other. Null stays null; an id without a piece is an error."""
    pieces = table.pieces

    @F.arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
        found = []
        for low, high in slices(lengths * 4, PART):
            part = rows[low:high]
            flat = part.flatten()
            if flat.null_count or len(flat) and not (0 <= pc.min(flat).as_py() and pc.max(flat).as_py() < len(pieces)):
                raise ValueError("an id has no piece")
            each = pieces.take(flat)
            if each.null_count:
                raise ValueError("an id has no piece")
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(each).to_numpy())])
            ends = ends[np.concatenate([[0], np.cumsum(lengths[low:high], dtype=np.int64)])]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), each.buffers()[2] or pa.py_buffer(b"")])
            found.append(pc.if_else(part.is_null(), pa.scalar(None, pa.large_binary()), joined).cast(pa.binary()))
        return pa.concat_arrays(found) if found else pa.array([], pa.binary())

    return bytes_of(ids)


def round_trip(docs: DataFrame, ranks: Mapping[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, decoded from them, ``bytes`` (binary); columns called like these are replaced."""
    table = rank_map(ranks)
    return encoded(docs, ranks, text, table=table).withColumn("bytes", decoded(F.col("ids"), table))
