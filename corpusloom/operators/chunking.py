"""Chunk tables: routing, splitting, sections, merging, ids, pages, ingest."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import html as H
from corpusloom.functions.text import let, record, strip
from corpusloom.functions.languages import HTML_EXTENSIONS, LANGUAGE_OF, TEXT_EXTENSIONS, separators
from corpusloom.operators.recursive_split import locate, split_text

# Splitter names, their order and the extensions they serve ("*" serves all).
SPLITTERS = (
    ("MarkdownTextSplitterAdapter", 10, (".md",)),
    ("HTMLTextSplitterAdapter", 10, HTML_EXTENSIONS),
    ("CodeTextSplitter", 10, tuple(LANGUAGE_OF)),
    ("UniversalTextSplitter", 100, ("*",)),
)
CHILD_SPLITTER = "ChildTextSplitter"
PARENT_SIZE, PARENT_OVERLAP = 1000, 120
CHILD_SIZE, CHILD_OVERLAP = 256, 50
SHORT_TEXT = 1500


# --- routing -------------------------------------------------------------------------------------------------


def language_of(extension: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension)


def splitter_for(extension: Column, registry=SPLITTERS) -> Column:
    """Name of the splitter with the smallest (order, registration) among those serving an extension."""
    ranked = sorted(enumerate(registry), key=lambda e: (e[1][1], e[0]))
    chosen = F.lit(None).cast("string")
    for _, (name, _, extensions) in reversed(ranked):
        serves = F.lit(True) if "*" in extensions else extension.isin(*extensions)
        label = F.lit(name)
        if name == "CodeTextSplitter":
            label = F.concat(F.lit(name + "("), language_of(extension), F.lit(")"))
        chosen = F.when(serves, label).otherwise(chosen)
    return chosen


def keeps_whole(extension: Column, length: Column, threshold: int = SHORT_TEXT, enabled: bool = True) -> Column:
    """Short plain-text files stay one parent."""
    return F.lit(enabled) & extension.isin(*TEXT_EXTENSIONS) & (length < threshold)


def with_lineage(lineage: Column, step: Column) -> Column:
    return F.concat(F.coalesce(lineage, F.array().cast("array<string>")), F.array(step))


# --- fixed windows -------------------------------------------------------------------------------------------


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (text, start_index) windows of ``size`` characters that share ``overlap`` characters.

    The text is cut once into steps and each window is its step plus the head of the next one, so the work is linear
    in the text however long it is. No Python, no shuffle.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must not exceed half the size")
    # A last step that lies wholly in the window before it opens no window of its own.
    count = F.floor((F.greatest(F.length(text) - overlap, F.lit(1)) - 1) / step).cast("int") + 1
    steps = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0))

    def cut(pieces: Column) -> Column:
        return F.transform(
            F.slice(pieces, 1, count),
            lambda piece, i: record(
                text=F.concat(piece, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, overlap)),
                start_index=(i * step).cast("int"),
            ),
        )

    return let(steps, cut)


def window_chunks(df: DataFrame, text: str, size: int, overlap: int, index: str, start: str | None = None) -> DataFrame:
    """One row per window; ``text`` is replaced by the window, ``index`` numbers windows from 0."""
    others = [c for c in df.columns if c != text]
    out = df.select(*others, F.posexplode(windows(F.col(text), size, overlap)).alias(index, "_w"))
    picked = [*others, index, F.col("_w.text").alias(text)]
    if start:
        picked.append(F.col("_w.start_index").alias(start))
    return out.select(*picked)


def window_parents(files: DataFrame, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """(file_id, text, …) -> (…, parent_index, parent_id, text)."""
    parents = window_chunks(files, "text", size, overlap, "parent_index")
    return parents.withColumn("parent_id", F.concat_ws(":", "file_id", "parent_index"))


def window_children(parents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    children = window_chunks(parents, "text", size, overlap, "child_index", "start_index")
    return children.withColumn("child_id", F.concat_ws(":", "parent_id", "child_index"))


# --- recursive splitting -------------------------------------------------------------------------------------


def split_rows(
    df: DataFrame,
    size: int,
    overlap: int,
    *,
    text: str = "text",
    language: str | None = None,
    index: str = "chunk_index",
    start: str = "start_index",
    rows_per_batch: int = 2000,
) -> DataFrame:
    """Recursive split of every row's text; all other columns repeat on each chunk. A map-side job, no shuffle.

    ``language`` names a column that selects code separators.
    """
    schema = T.StructType(
        [f for f in df.schema.fields]
        + [T.StructField(index, T.IntegerType()), T.StructField(start, T.IntegerType())]
    )
    columns = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                values = dict(zip(columns, row))
                kind = values[language] if language else None
                kind = kind if isinstance(kind, str) else None
                chunks = split_text(values[text], size, overlap, separators(kind))
                for i, (chunk, at) in enumerate(zip(chunks, locate(values[text], chunks, overlap))):
                    out.append(tuple(chunk if c == text else values[c] for c in columns) + (i, at))
                    if len(out) >= rows_per_batch:
                        yield pd.DataFrame(out, columns=[*columns, index, start])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[*columns, index, start])

    return df.mapInPandas(run, schema)


# --- sections ------------------------------------------------------------------------------------------------


def markdown_sections(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, text) -> (key, section_index, text, header_1, header_2); cut at ``#`` and ``##`` outside code fences.

    Header lines stay in the text. A header directly below a shallower one shares its section.
    """
    lines = files.select(key, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", strip("raw"))
    doc = Window.partitionBy(key).orderBy("line")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)

    fence = F.col("raw").rlike(r"^(```|~~~)")
    lines = lines.withColumn("in_code", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1)
    level = F.when(~F.col("in_code") & F.col("raw").rlike(r"^#( |$)"), 1).when(
        ~F.col("in_code") & F.col("raw").rlike(r"^##( |$)"), 2
    )
    blank = (F.col("raw") == "") & ~F.col("in_code")
    lines = lines.withColumn("level", level).withColumn("gap", F.coalesce(F.lag(blank).over(doc), F.lit(False)))
    lines = lines.where(~blank)

    title = strip(F.regexp_replace("raw", r"^#+", ""))
    lines = (
        lines.withColumn("h1_no", F.coalesce(F.sum((F.col("level") == 1).cast("int")).over(upto), F.lit(0)))
        .withColumn("header_1", F.last(F.when(F.col("level") == 1, title), ignorenulls=True).over(upto))
        .withColumn("h2", F.when(F.col("level") == 2, F.struct("h1_no", title.alias("t"))))
        .withColumn("h2", F.last("h2", ignorenulls=True).over(upto))
        .withColumn("header_2", F.when(F.col("h2.h1_no") == F.col("h1_no"), F.col("h2.t")))
        .withColumn("depth", F.col("header_1").isNotNull().cast("int") + F.col("header_2").isNotNull().cast("int"))
    )
    continues = F.lag("raw").over(doc).startswith("#") & (F.lag("depth").over(doc) < F.col("depth"))
    opens = F.col("level").isNotNull() & ~F.coalesce(continues, F.lit(False))
    lines = lines.withColumn("opens", opens).withColumn(
        "section", F.coalesce(F.sum(opens.cast("int")).over(upto), F.lit(0))
    )
    first = F.lag("section").over(doc).isNull() | (F.lag("section").over(doc) != F.col("section"))
    glue = F.when(first, "").when(F.col("gap") | F.col("level").isNotNull(), "  \n").otherwise("\n")
    lines = lines.withColumn("piece", F.concat(glue, "raw"))

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda s: s["piece"]), "")
    return (
        lines.groupBy(key, "section")
        .agg(
            text.alias("text"),
            F.max_by("header_1", "line").alias("header_1"),
            F.max_by("header_2", "line").alias("header_2"),
        )
        .withColumn("section_index", F.dense_rank().over(Window.partitionBy(key).orderBy("section")) - 1)
        .select(key, "section_index", "text", "header_1", "header_2")
    )


def html_sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, html) -> (key, section_index, text, header_1, header_2); cut before ``h1`` and ``h2`` of the body."""
    body = H.body_fragment(F.col(html))
    parts = F.split(body, r"(?i)(?=<h[12][\s>])")
    cut = pages.select(key, F.posexplode(parts).alias("part", "raw"))
    heading = strip(H.unescape(F.regexp_replace(F.regexp_extract("raw", r"(?is)^<h[12][^>]*>(.*?)</h[12]\s*>", 1), r"<[^>]*>", "")))
    level = F.nullif(F.regexp_extract("raw", r"(?i)^<h([12])", 1), F.lit("")).cast("int")
    cut = cut.select(key, "part", level.alias("level"), heading.alias("heading"), H.strip_tags(F.col("raw")).alias("text"))
    upto = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        cut.withColumn("h1_no", F.coalesce(F.sum((F.col("level") == 1).cast("int")).over(upto), F.lit(0)))
        .withColumn("header_1", F.last(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(upto))
        .withColumn("h2", F.last(F.when(F.col("level") == 2, F.struct("h1_no", "heading")), ignorenulls=True).over(upto))
        .withColumn("header_2", F.when(F.col("h2.h1_no") == F.col("h1_no"), F.col("h2.heading")))
        .where(F.col("text") != "")
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return cut.select(key, number.alias("section_index"), "text", "header_1", "header_2")


def _common(a: tuple, b: tuple) -> tuple:
    shared = []
    for x, y in zip(a, b):
        if x != y:
            break
        shared.append(x)
    return tuple(shared)


def merge_blocks(blocks: list[tuple[str, tuple]], size: int, separator: str = "\n\n") -> list[tuple[str, tuple]]:
    """Bottom-up merge of neighbours that fit: deepest shared header prefix first, then leftmost.

    A heap of neighbour pairs and a linked list make this n·log n in the blocks of one document.
    """
    count = len(blocks)
    text = [b[0] for b in blocks]
    path = [b[1] for b in blocks]
    before = [i - 1 for i in range(count)]
    after = [i + 1 for i in range(count)]
    age = [0] * count
    heap: list[tuple] = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else count
        if left < 0 or right >= count or len(text[left]) + len(separator) + len(text[right]) > size:
            return
        heapq.heappush(heap, (-len(_common(path[left], path[right])), left, right, age[left], age[right]))

    for i in range(count):
        offer(i)
    while heap:
        _, left, right, left_age, right_age = heapq.heappop(heap)
        if after[left] != right or age[left] != left_age or age[right] != right_age:
            continue
        path[left] = _common(path[left], path[right])
        text[left] = text[left] + separator + text[right]
        age[left] += 1
        age[right] = -1
        after[left] = after[right]
        if after[right] < count:
            before[after[right]] = left
        offer(before[left])
        offer(left)
    merged, at = [], 0
    while at < count:
        merged.append((text[at], path[at]))
        at = after[at]
    return merged


def structured_parents(sections: DataFrame, key: str = "file_id", size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """Structural merge of each document's sections; only merged blocks that are still too long are split again.

    A document's sections are put into one row, bounded by its text, and rows stream through in Arrow batches.
    """
    kind = sections.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, block_index int, chunk_index int, text string, header_1 string, header_2 string"
    columns = [key, "block_index", "chunk_index", "text", "header_1", "header_2"]
    ordered = F.array_sort(F.collect_list(F.struct("section_index", "text", "header_1", "header_2")))
    documents = sections.groupBy(key).agg(ordered.alias("sections"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, found in zip(batch[key], batch["sections"]):
                blocks = [(s["text"], tuple((n, h) for n, h in ((1, s["header_1"]), (2, s["header_2"])) if h is not None)) for s in found]
                for i, (text, path) in enumerate(merge_blocks(blocks, size)):
                    headers = dict(path)
                    chunks = [text] if len(text) <= size else split_text(text, size, overlap)
                    out.extend((value, i, j, chunk, headers.get(1), headers.get(2)) for j, chunk in enumerate(chunks))
            yield pd.DataFrame(out, columns=columns)

    return documents.mapInPandas(run, schema)


# --- ids, links, pages ---------------------------------------------------------------------------------------


def content_id(*parts: Column) -> Column:
    """Deterministic chunk id from position and content, so that a rerun writes the same ids."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def linked_chunks(files: DataFrame, size=PARENT_SIZE, overlap=PARENT_OVERLAP, child_size=CHILD_SIZE, child_overlap=CHILD_OVERLAP) -> DataFrame:
    """Parents with content ids and their children nested in order: ids and links without any shuffle."""
    parents = window_chunks(files, "text", size, overlap, "parent_index")
    parents = parents.withColumn("parent_id", content_id(F.col("file_id"), F.col("parent_index"), F.col("text")))
    children = F.transform(
        windows(F.col("text"), child_size, child_overlap),
        lambda w, i: record(
            child_id=content_id(F.col("parent_id"), i, w["text"]),
            child_index=i.cast("int"),
            start_index=w["start_index"],
            text=w["text"],
        ),
    )
    parents = parents.withColumn("children", children)
    return parents.withColumns(
        {"children_ids": F.transform("children", lambda c: c["child_id"]), "children_count": F.size("children")}
    )


def page(rows: DataFrame, key: str, index: str, offset: Column, limit: Column) -> DataFrame:
    """``[offset, offset + limit)`` of each key's rows by their dense index, with the key's total."""
    wanted = rows.where((F.col(index) >= offset) & (F.col(index) < offset + limit))
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return wanted.join(totals, key)


def merge_consecutive(parents: DataFrame, keys: Sequence[str], index: str = "parent_index", text: str = "text", id_col: str = "parent_id") -> DataFrame:
    """Join runs of neighbouring parents into the first of each run (gaps and islands)."""
    window = Window.partitionBy(*keys).orderBy(index)
    runs = parents.withColumn("_run", F.col(index) - F.row_number().over(window))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(text))))
    return (
        runs.groupBy(*keys, "_run")
        .agg(
            F.min_by(id_col, index).alias(id_col),
            F.min(index).alias(index),
            F.count("*").alias("merged_count"),
            F.array_join(F.transform(pieces, lambda s: s[text]), "\n\n").alias(text),
        )
        .drop("_run")
    )


# --- ingest --------------------------------------------------------------------------------------------------


def ingest(
    files: DataFrame,
    *,
    size: int = PARENT_SIZE,
    overlap: int = PARENT_OVERLAP,
    child_size: int = CHILD_SIZE,
    child_overlap: int = CHILD_OVERLAP,
    short_text: int = SHORT_TEXT,
    bypass: bool = True,
    use_parent: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(file_id, file_extension, text) -> (parents, children): route, split, number, link.

    Files are read and split once, by the splitters that come with the library; ``loading.load`` takes others as well and
    tells which files failed.
    """
    from corpusloom.operators.loading import load  # which builds on this module

    found = load(
        files, size=size, overlap=overlap, child_size=child_size, child_overlap=child_overlap, short_text=short_text, bypass=bypass, use_parent=use_parent
    )
    return found.parents(), found.children()


def flat_preset(files: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """First-version layout: one level of chunks, the document is the parent."""
    return split_rows(files, size, overlap)


def load_summary(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Per file: how many parents and children were written and by which splitter."""
    kids = children.groupBy("file_id").agg(F.count("*").alias("children_count"))
    return (
        parents.groupBy("file_id")
        .agg(
            F.count("*").alias("parent_count"),
            F.sum(F.length("text")).alias("total_chars"),
            F.max(F.length("text")).alias("max_chars"),
            F.min(F.array_join("text_splitters", ">")).alias("splitter"),
        )
        .join(kids, "file_id", "left")
        .withColumn("children_count", F.coalesce("children_count", F.lit(0)))
    )
