"""Recursive character splitting of one text, the per-row helper behind the chunk tables.

Rule (public text-splitter documentation): take the first separator that occurs, keep it at the head of the
piece that follows, join small pieces greedily up to the size, carry an overlap from the left, and recurse into
pieces that are still too long with the remaining separators.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

# Separators of the general splitter, coarse to fine.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of ``text``, each separator opening the piece after it."""
    if separator == "":
        return list(text)
    starts = [0]
    for hit in re.finditer(separator, text):
        if hit.start() > 0 and hit.end() > hit.start():
            starts.append(hit.start())
    ends = starts[1:] + [len(text)]
    return [text[a:b] for a, b in zip(starts, ends) if b > a]


def _pack(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows over consecutive pieces: at most ``size`` long, at most ``overlap`` shared with the one before."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        grown = held + len(piece)
        if grown > size and window:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def _walk(text: str, separators: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    level = next((i for i, s in enumerate(separators) if s == "" or re.search(s, text)), len(separators) - 1)
    finer = separators[level + 1 :]
    small: list[str] = []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if finer:
            yield from _walk(piece, finer, size, overlap)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = PLAIN_SEPARATORS, regex: bool = False) -> list[str]:
    """Chunks of ``text``: stripped, never empty, in order."""
    patterns = list(separators) if regex else [re.escape(s) for s in separators]
    return [c for c in (chunk.strip() for chunk in _walk(text or "", patterns, size, overlap)) if c]


def locate(text: str, chunks: Sequence[str], overlap: int) -> list[int]:
    """Start offset of each chunk, searched forward from the end of the previous one less the overlap."""
    offsets: list[int] = []
    at, length = 0, 0
    for chunk in chunks:
        at = text.find(chunk, max(0, at + length - overlap))
        offsets.append(at)
        length = len(chunk)
    return offsets
