"""Words of UTF-8 texts as arrays of hashes: the part of the array work that several operators share.

Everything works on whole columns of texts at once. Hashes are 64 bits wide and depend on a word's bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about this many bytes, cut between words, so that scratch arrays stay small.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection for each salt)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        one = np.full(size, base, np.uint64)
        two = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        one[0] = two[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(one), np.multiply.accumulate(two)
        _POWERS[base] = have
    return have


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash for each span [start, end) of an array of 64-bit values: equal spans, equal hashes, wherever they stand."""
    base = (int(_BASE) + 2 * salt * 0x1234567 | 5) & ((1 << 64) - 1)
    power, inverse = _powers(len(values), base)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
        raw = (sums[end] - sums[start]) * inverse[start]
        return mixed(raw + (end - start).astype(np.uint64) * _BASE, salt + 1)


@dataclass
class Words:
    """The words of several texts: where each lies in ``data``, its hash, and per text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i

    def text(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words between the six white-space characters; a null text has none. ``lower`` turns A-Z into a-z first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        offsets = np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    at = bounds[(bounds > 0) & (bounds < n)]
    opens[at] = inside[at]  # a text's first byte starts a word, whatever the text before ends with
    closes[at - 1] = inside[at - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashed = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(start, start[low] + PIECE)))
        from_, to = start[low], end[high - 1]
        hashed[low:high] = spans_hash(_BYTE[data[from_:to]], start[low:high] - from_, end[low:high] - from_)
        low = high
    return Words(data, start, end, hashed, np.searchsorted(start, bounds))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes together; a larger row is a range of its own."""
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += int(size)
    if low < len(sizes):
        yield low, len(sizes)
