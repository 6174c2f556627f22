"""Loading files into chunks in one pass: a registry of splitters, and an outcome for each file, be it chunks or an error.

Every file is read, routed and split once, where it lies; nothing is shuffled. A file whose splitter fails has an error
instead of chunks, so that the others go on and no half of it is ever stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import html as H
from corpusloom.functions.languages import HTML_EXTENSIONS, LANGUAGE_OF, separators
from corpusloom.functions.text import BLANKS, record, strip
from corpusloom.operators import chunking
from corpusloom.operators.recursive_split import locate, split_text
from corpusloom.session import durable
from corpusloom.sources.tables import publish

#: Files in a batch on their way back from a splitter, as one file may be many chunks.
BATCH = 256


class Source(NamedTuple):
    """What a splitter gets: the text, its code language or None, the pieces of a web page or None, and the sizes."""

    text: str
    language: str | None
    pieces: list[dict] | None
    size: int
    overlap: int


class Part(NamedTuple):
    """What a splitter gives, in order."""

    text: str
    header_1: str | None = None
    header_2: str | None = None


@dataclass(frozen=True)
class Splitter:
    """``split`` serves the extensions in ``serves`` ("*" serves all); a smaller ``order`` comes first."""

    name: str
    serves: tuple[str, ...]
    split: Callable[[Source], Iterable[Part]]
    order: int = 10

    def label(self, language: str | None) -> str:
        return f"{self.name}({language})" if self.name == "CodeTextSplitter" else self.name


@dataclass(frozen=True)
class Registry:
    splitters: tuple[Splitter, ...] = ()

    def register(self, splitter: Splitter) -> Registry:
        """A registry that also knows ``splitter``; of equal order, those registered first come first."""
        if any(s.name == splitter.name for s in self.splitters):
            raise ValueError(f"a splitter is called {splitter.name} already")
        return replace(self, splitters=(*self.splitters, splitter))

    def chosen(self, extension: str | None) -> Splitter | None:
        for splitter in sorted(self.splitters, key=lambda s: s.order):
            if "*" in splitter.serves or extension in splitter.serves:
                return splitter
        return None


# --- the splitters that come with it --------------------------------------------------------------------------


def by_separators(source: Source) -> Iterator[Part]:
    yield from map(Part, split_text(source.text, source.size, source.overlap, separators(source.language)))


def markdown_blocks(text: str) -> list[tuple[str, tuple]]:
    """Sections cut at ``#`` and ``##`` outside code fences, each with its headers; see ``chunking.markdown_sections``."""
    sections: list[list] = []
    fenced = gap = False
    header_1 = header_2 = None
    before: tuple[str, int] | None = None  # the line before and how many headers it lies under
    for raw in (line.strip(BLANKS) for line in text.split("\n")):
        inside, blank = fenced, raw == "" and not fenced
        fenced ^= raw.startswith(("```", "~~~"))
        gap, after_gap = blank, gap
        if blank:
            continue
        marks = len(raw) - len(raw.lstrip("#"))
        level = marks if not inside and marks in (1, 2) and raw[marks : marks + 1] in ("", " ") else 0
        if level == 1:
            header_1, header_2 = raw.lstrip("#").strip(BLANKS), None
        elif level == 2:
            header_2 = raw.lstrip("#").strip(BLANKS)
        depth = (header_1 is not None) + (header_2 is not None)
        continues = before is not None and before[0].startswith("#") and before[1] < depth
        before = (raw, depth)
        if not sections or (level and not continues):
            sections.append([raw, None])
        else:
            sections[-1][0] += ("  \n" if after_gap or level else "\n") + raw
        sections[-1][1] = (header_1, header_2)
    return [(body, _path(*headers)) for body, headers in sections]


def _path(header_1: str | None, header_2: str | None) -> tuple:
    return tuple((n, h) for n, h in ((1, header_1), (2, header_2)) if h is not None)


def page_blocks(pieces: list[dict]) -> list[tuple[str, tuple]]:
    """Sections of a web page from its pieces, which begin at ``h1`` and ``h2``; see ``chunking.html_sections``."""
    out, header_1, header_2 = [], None, None
    for piece in pieces:
        if piece["level"] == 1:
            header_1, header_2 = piece["heading"], None
        elif piece["level"] == 2:
            header_2 = piece["heading"]
        if piece["text"]:
            out.append((piece["text"], _path(header_1, header_2)))
    return out


def merged(blocks: list[tuple[str, tuple]], source: Source) -> Iterator[Part]:
    for text, path in chunking.merge_blocks(blocks, source.size):
        headers = dict(path)
        for chunk in [text] if len(text) <= source.size else split_text(text, source.size, source.overlap):
            yield Part(chunk, headers.get(1), headers.get(2))


def by_markdown(source: Source) -> Iterator[Part]:
    yield from merged(markdown_blocks(source.text), source)


def by_page(source: Source) -> Iterator[Part]:
    yield from merged(page_blocks(source.pieces or []), source)


_OWN = {"MarkdownTextSplitterAdapter": by_markdown, "HTMLTextSplitterAdapter": by_page}
STANDARD = Registry(tuple(Splitter(name, serves, _OWN.get(name, by_separators), order) for name, order, serves in chunking.SPLITTERS))


def page_pieces(html: Column) -> Column:
    """A page's body cut before each ``h1`` and ``h2``: array of (level, heading, text)."""
    heading = lambda raw: strip(H.unescape(F.regexp_replace(F.regexp_extract(raw, r"(?is)^<h[12][^>]*>(.*?)</h[12]\s*>", 1), r"<[^>]*>", "")))
    level = lambda raw: F.nullif(F.regexp_extract(raw, r"(?i)^<h([12])", 1), F.lit("")).cast("int")
    parts = F.split(H.body_fragment(html), r"(?i)(?=<h[12][\s>])")
    return F.transform(parts, lambda raw: record(level=level(raw), heading=heading(raw), text=H.strip_tags(raw)))


# --- loading --------------------------------------------------------------------------------------------------

_CHILD = pa.struct([("start_index", pa.int32()), ("text", pa.string())])
_PARENT = pa.struct([("text", pa.string()), ("header_1", pa.string()), ("header_2", pa.string()), ("children", pa.list_(_CHILD))])
PARENTS = "array<struct<text:string,header_1:string,header_2:string,children:array<struct<start_index:int,text:string>>>>"


@dataclass(frozen=True)
class Loaded:
    """``outcomes``: one row per file (file_id, file_extension, document_loader, text_splitters, text_length, error, seconds, parents);
    ``files`` and ``rejected`` are counted while it is written."""

    outcomes: DataFrame
    files: int
    rejected: int

    def rejects(self) -> DataFrame:
        """(file_id, file_extension, error) of the files without chunks."""
        return self.outcomes.where(F.col("error").isNotNull()).select("file_id", "file_extension", "error")

    def _numbered(self) -> DataFrame:
        rows = self.outcomes.where(F.col("error").isNull())
        rows = rows.select("file_id", "file_extension", "text_splitters", F.posexplode("parents").alias("parent_index", "p"))
        parent_id = chunking.content_id(F.col("file_id"), F.col("parent_index"), F.col("p.text"))
        return rows.withColumn("parent_id", parent_id)

    def parents(self) -> DataFrame:
        return self._numbered().select(
            "parent_id", "file_id", "file_extension", "parent_index", F.col("p.text").alias("text"), F.col("p.header_1").alias("header_1"), F.col("p.header_2").alias("header_2"), "text_splitters"
        )

    def children(self) -> DataFrame:
        rows = self._numbered().select("parent_id", "file_id", "file_extension", "text_splitters", F.posexplode("p.children").alias("child_index", "c"))
        return rows.select(
            chunking.content_id(F.col("parent_id"), F.col("child_index"), F.col("c.text")).alias("child_id"),
            "parent_id", "file_id", "file_extension", "child_index", F.col("c.start_index").alias("start_index"), F.col("c.text").alias("text"),
            chunking.with_lineage(F.col("text_splitters"), F.lit(chunking.CHILD_SPLITTER)).alias("text_splitters"),
        )

    def summary(self) -> DataFrame:
        """Per file what was loaded, by what, in which time, and what went wrong."""
        parent_ids = F.transform("parents", lambda p, i: chunking.content_id(F.col("file_id"), i, p["text"]))
        children = F.aggregate("parents", F.lit(0), lambda n, p: n + F.size(p["children"]))
        return self.outcomes.select(
            "file_id", "document_loader", F.array_join("text_splitters", ">").alias("splitter"), F.coalesce(parent_ids, F.array().cast("array<string>")).alias("parent_ids"),
            F.coalesce(F.size("parents"), F.lit(0)).alias("parent_count"), F.coalesce(children, F.lit(0)).alias("children_count"), "text_length", "seconds", "error",
        )

    def published(self, root: str, version: str, most_rejected: float = 1.0) -> dict[str, str]:
        """Publish parents, children and rejects under one version, unless too large a part of the files was refused."""
        if self.rejected > most_rejected * self.files:
            raise ValueError(f"{self.rejected} of {self.files} files were refused")
        return publish({"parents": self.parents(), "children": self.children(), "rejects": self.rejects()}, root, version)


def load(
    files: DataFrame, registry: Registry = STANDARD, *, size: int = chunking.PARENT_SIZE, overlap: int = chunking.PARENT_OVERLAP,
    child_size: int = chunking.CHILD_SIZE, child_overlap: int = chunking.CHILD_OVERLAP, short_text: int = chunking.SHORT_TEXT,
    bypass: bool = True, use_parent: bool = True,
) -> Loaded:
    """Split files (file_id, file_extension, text, and document_loader if they have it) into parents and children.

    Short plain texts, or with ``use_parent=False`` all, stay one parent. Errors are "no text" for null, "no splitter" for
    an extension that nothing serves, "no chunks" where a splitter gave nothing, else kind and message of what it raised.
    """
    whole = F.lit(not use_parent) | chunking.keeps_whole(F.col("file_extension"), F.length("text"), short_text, bypass)
    loader = F.col("document_loader") if "document_loader" in files.columns else F.lit(None).cast("string")
    pages = F.col("file_extension").isin(*HTML_EXTENSIONS) & ~F.coalesce(whole, F.lit(False))
    rows = files.select(
        "file_id", "file_extension", loader.alias("document_loader"), "text", F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(pages, page_pieces(F.col("text"))).alias("pieces"),
    )
    out = T.StructType([rows.schema[c] for c in ("file_id", "file_extension", "document_loader")])
    out = T.StructType([*out.fields, *T.StructType.fromDDL(f"text_splitters array<string>, text_length int, error string, seconds double, parents {PARENTS}").fields])

    def children(text: str) -> list[dict]:
        chunks = split_text(text, child_size, child_overlap)
        return [{"start_index": at, "text": chunk} for chunk, at in zip(chunks, locate(text, chunks, child_overlap))]

    def outcome(extension: str | None, text: str | None, keep: bool, pieces: list[dict] | None) -> tuple:
        begun = time.perf_counter()
        names: list[str] = []
        error, found = None, None
        if text is None:
            error = "no text"
        else:
            try:
                if keep:
                    parts: Sequence[Part] = [Part(text)]
                elif (splitter := registry.chosen(extension)) is None:
                    parts, error = [], "no splitter"
                else:
                    language = LANGUAGE_OF.get(extension)
                    names = [splitter.label(language)]
                    parts = [Part(*p) for p in splitter.split(Source(text, language, pieces, size, overlap))]
                found = [{**p._asdict(), "children": children(p.text)} for p in parts]
                error = error or (None if found else "no chunks")
            except Exception as problem:  # noqa: BLE001 - whatever a registered splitter raises is that file's outcome
                error = f"{type(problem).__name__}: {problem}"
        return names, None if text is None else len(text), error, time.perf_counter() - begun, None if error else found

    types = [pa.list_(pa.string()), pa.int32(), pa.string(), pa.float64(), pa.list_(_PARENT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                columns = zip(*(some.column(c).to_pylist() for c in ("file_extension", "text", "whole", "pieces")))
                made = [pa.array(list(values), kind) for values, kind in zip(zip(*(outcome(*c) for c in columns)), types)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), *made], names=out.names)

    seen = Observation()
    rejected = F.count_if(F.col("error").isNotNull()).alias("rejected")
    told = durable(rows.mapInArrow(run, out).observe(seen, F.count(F.lit(1)).alias("files"), rejected))
    counts = seen.get
    return Loaded(told, counts.get("files", 0), counts.get("rejected", 0))
