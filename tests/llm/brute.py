"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_spans(docs: list[tuple], window: int = 35) -> list[tuple]:
    """docs: (doc_id, text)."""
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple]) -> list[tuple]:
    """docs: (doc_id, text); links by 100 * intersection >= 80 * union."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = d if least[r] is None else min(least[r], d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]


def base_measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), n < 20 or 100 * len(repeat) > 30 * n


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    marks = defaultdict(set)
    for key, text in items:
        w = ITEM_WORD.findall(lowered(text))
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                marks[tuple(w[i : i + n])].add(key)
    out = []
    for d, text in docs:
        w = ITEM_WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(m) for m in marks}:
            for i in range(len(w) - n + 1):
                if (m := tuple(w[i : i + n])) in marks:
                    hit.update(range(i, i + n))
                    found |= marks[m]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(str(k) for k in found if k is not None))), bool(hit)))
    return out
