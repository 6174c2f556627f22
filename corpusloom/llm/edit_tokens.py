"""Token counts that follow edits: a segment tree over pre-tokens, of which an edit re-encodes only its surroundings."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie; a parameter everywhere.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf of the tree.
LEAF = 64
#: Most entries of a task's table of pre-tokens seen; a full table starts anew.
TABLE = 1 << 20

_SPLIT = regex.compile(PATTERN)


def counter(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """The number of tokens of one pre-token under a vocabulary of ranks."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    seen: dict[str, int] = {}

    def count(piece: str) -> int:
        n = seen.get(piece)
        if n is None:
            if len(seen) >= TABLE:
                seen.clear()
            n = seen[piece] = len(encode(piece))
        return n

    return count


@dataclass
class Leaf:
    """Neighbouring pre-tokens: their lengths in characters and their token counts."""

    sizes: list[int]
    counts: list[int]


class CountedText:
    """A text with a segment tree over its pre-tokens; every inner node holds the characters and tokens below it.

    ``replace`` edits the text. Only pre-tokens from a little before the edit on are split and encoded again, up to the
    first place behind it where the old and the new cuts agree; then the sums on the paths to the root are updated.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf = count, leaf
        self.text = text
        pieces = _SPLIT.findall(text)
        self.encoded = 0  # pre-tokens encoded by edits
        sizes, counts = [len(p) for p in pieces], [count(p) for p in pieces]
        self.leaves = [Leaf(sizes[i : i + leaf], counts[i : i + leaf]) for i in range(0, len(pieces), leaf)] or [Leaf([], [])]
        self._build()

    def _build(self) -> None:
        width = 1
        while width < len(self.leaves):
            width *= 2
        self.width = width
        self.chars = np.zeros(2 * width, np.int64)
        self.tokens = np.zeros(2 * width, np.int64)
        self.chars[width : width + len(self.leaves)] = [sum(x.sizes) for x in self.leaves]
        self.tokens[width : width + len(self.leaves)] = [sum(x.counts) for x in self.leaves]
        for level in (self.chars, self.tokens):
            w = width
            while w > 1:
                level[w // 2 : w] = level[w : 2 * w : 2] + level[w + 1 : 2 * w : 2]
                w //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def pieces(self) -> int:
        return sum(len(x.sizes) for x in self.leaves)

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds character ``at``, by descent from the root."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters [start, end); places outside the text are moved to its ends."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        low, before = self.locate(max(start - 1, 0))
        cut, at = 0, before  # the first pre-token to split again: two before the one that holds the edit's start
        sizes = self.leaves[low].sizes
        while cut < len(sizes) and at + sizes[cut] < start:
            at += sizes[cut]
            cut += 1
        for _ in range(2):
            if cut == 0 and low > 0:
                low -= 1
                cut = len(self.leaves[low].sizes)
            if cut > 0:
                cut -= 1
                at -= self.leaves[low].sizes[cut]
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        old = self._old(low, cut, at)
        reach, made_sizes, made_counts, pos = start + len(new), [], [], at
        leaf, index, edge = next(old)
        for match in _SPLIT.finditer(text, at):
            while leaf < len(self.leaves) and edge + shift < pos:
                leaf, index, edge = next(old)
            # behind the edit, cuts that agree at a word's own begin stay in step from there on
            if pos > reach and leaf < len(self.leaves) and edge + shift == pos and not text[pos - 1].isspace() and edge > end:
                break
            piece = match.group()
            made_sizes.append(len(piece))
            made_counts.append(self.count(piece))
            self.encoded += 1
            pos = match.end()
        else:
            leaf, index = len(self.leaves), 0
        self.text = text
        self._splice(low, cut, leaf, index, made_sizes, made_counts)

    def _old(self, leaf: int, index: int, at: int) -> Iterator[tuple[int, int, int]]:
        """(leaf, index, first character) of the old pre-tokens from one on, then an end mark."""
        while leaf < len(self.leaves):
            sizes = self.leaves[leaf].sizes
            while index < len(sizes):
                yield leaf, index, at
                at += sizes[index]
                index += 1
            leaf, index = leaf + 1, 0
        while True:
            yield len(self.leaves), 0, at

    def _splice(self, low: int, cut: int, leaf: int, index: int, sizes: list[int], counts: list[int]) -> None:
        """The new pre-tokens in the place of those from (low, cut) up to (leaf, index)."""
        tail = self.leaves[leaf] if leaf < len(self.leaves) else Leaf([], [])
        head = self.leaves[low]
        sizes = head.sizes[:cut] + sizes + tail.sizes[index:]
        counts = head.counts[:cut] + counts + tail.counts[index:]
        last = min(leaf, len(self.leaves) - 1)
        room = last - low + 1
        step = max(self.leaf, -(-len(sizes) // room))
        parts = [Leaf(sizes[i : i + step], counts[i : i + step]) for i in range(0, len(sizes), step)]
        parts += [Leaf([], []) for _ in range(room - len(parts))]
        self.leaves[low : last + 1] = parts
        if step > 4 * self.leaf:  # leaves have grown too long: deal all of them anew
            flat = Leaf([s for x in self.leaves for s in x.sizes], [c for x in self.leaves for c in x.counts])
            self.leaves = [Leaf(flat.sizes[i : i + self.leaf], flat.counts[i : i + self.leaf]) for i in range(0, len(flat.sizes), self.leaf)] or [Leaf([], [])]
            self._build()
            return
        touched = set()
        for i, part in enumerate(parts, low + self.width):
            self.chars[i], self.tokens[i] = sum(part.sizes), sum(part.counts)
            touched.add(i // 2)
        while touched and 0 not in touched:
            for i in touched:
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            touched = {i // 2 for i in touched}


def counted(docs: DataFrame, edits: str = "edits", key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(key, n_tokens, n_tokens_after, n_pieces, n_encoded, edited_text) for every row of ``docs``.

    ``edits`` is an array of (start, end, new) in characters, applied one after the other, each to the text that the one
    before it left. A null text counts as empty, null edits as none, an edit with a null field is left out, and places
    outside the text are moved to its ends. n_pieces are the pre-tokens of the text before, n_encoded those that the
    edits had to encode. Rows are independent: repeated rows and null keys are counted like others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counter(folder, vocabulary)
        for batch in batches:
            told: list[tuple] = []
            for value, changes in zip(batch["text"], batch["edits"], strict=True):
                held = CountedText(value.as_py() or "", number, leaf)
                before, pieces = held.total, held.pieces
                for e in changes.as_py() or ():
                    if e is not None and None not in e.values():
                        held.replace(e["start"], e["end"], e["new"])
                told.append((before, held.total, pieces, held.encoded, held.text))
            columns = [pa.array(x, t) for x, t in zip(zip(*told, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)] if told else [pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns], names=["key", *NAMES])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(edits).cast("array<struct<start:bigint,end:bigint,new:string>>").alias("edits"))
    kind = rows.schema["key"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in NAMES[:-1])
    return rows.mapInArrow(count, f"key {kind}, {longs}, {NAMES[-1]} string").withColumnRenamed("key", key)


NAMES: Sequence[str] = ("n_tokens", "n_tokens_after", "n_pieces", "n_encoded", "edited_text")


def sample_edits(text: Column, source: Column, n: Column) -> Column:
    """Three edits of any text, made from the row: its source's name at a quarter, 40 characters less in the middle, a
    changed word near the end."""
    size = F.length(F.coalesce(text, F.lit("")))
    quarter, half, late = (F.floor(size * x).cast("long") for x in (0.25, 0.5, 0.75))
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), new.alias("new"))
    return F.array(
        edit(quarter, quarter, F.concat(F.lit(" "), F.coalesce(source, F.lit("none")), F.lit(" "))),
        edit(half, half + 40, F.lit("")),
        edit(late, late + 3, F.concat(F.lit("x"), F.coalesce(n, F.lit(0)).cast("string"))),
    )
