"""Loading in one pass: registered splitters, outcomes, and the same sections as the table jobs give."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C
from corpusloom.operators import loading as L
from corpusloom.sources import tables as T

SCHEMA = "file_id string, file_extension string, text string"
LINES = ["# One", "## Two", "### Three", "text", "", "  more words  ", "```", "# not a header", "~~~", "#", "##", "#tag", "## Two again", " # shifted", "\t", "a\rb"]
TAGS = ["<h1>Top</h1>", "<h2 class='x'>Sub &amp; more</h2>", "<p>Some text.</p>", "<h1>", "</h2>", "<H1>Caps</H1>", "<div>loose", "<!-- <h1>no</h1> -->", "<h3>Three</h3>", "<nav><h1>menu</h1></nav>", "words ", "<h2></h2>", "<table><tr><td>1</td></tr></table>"]


def files(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_sections_equal_the_table_jobs(spark):
    """Cutting inside the row and cutting by windows over lines give the same parents."""
    draw = random.Random(11)
    markdown = [(f"m{i}", ".md", "\n".join(draw.choice(LINES) for _ in range(draw.randrange(0, 40)))) for i in range(120)]
    pages = [(f"p{i}", ".html", "<html><head><title>t</title></head><body>" + "".join(draw.choice(TAGS) for _ in range(draw.randrange(0, 25))) + "</body></html>") for i in range(120)]
    got = L.load(files(spark, markdown + pages), size=60, overlap=10, bypass=False).parents()
    for name, made, cut in (("m", markdown, C.markdown_sections), ("p", pages, lambda d: C.html_sections(d, "file_id", "text"))):
        want = C.structured_parents(cut(files(spark, made)), size=60, overlap=10)
        order = "row_number() OVER (PARTITION BY file_id ORDER BY block_index, chunk_index) - 1"
        want = want.withColumn("parent_index", F.expr(order))
        columns = ["file_id", "parent_index", "text", F.coalesce("header_1", F.lit("-")).alias("a"), F.coalesce("header_2", F.lit("-")).alias("b")]
        found = rows_of(got.where(F.col("file_id").startswith(name)), *columns)
        assert found == rows_of(want, *columns) and found


def words_of_ten(source):
    words = source.text.split(" ")
    if "boom" in words:
        raise KeyError("boom")
    for i in range(0, len(words), 10):
        yield L.Part(" ".join(words[i : i + 10]), header_1=source.language)


def test_a_registered_splitter_and_its_failures(spark):
    registry = L.STANDARD.register(L.Splitter("Tens", (".py", ".log"), words_of_ten, order=1)).register(L.Splitter("Nothing", (".nil",), lambda source: [], order=1))
    long = "word " * 400
    rows = [("a", ".py", long), ("b", ".log", "x boom " + long), ("c", ".txt", long), ("d", ".txt", None), ("e", ".nil", long), ("f", None, long), (None, ".log", "just one"), ("a", ".log", "twice the id")]
    found = L.load(files(spark, rows).withColumn("document_loader", F.lit("TextLoader")), registry, bypass=False)
    assert (found.files, found.rejected) == (8, 3)
    assert rows_of(found.rejects(), "file_id", "error") == [("b", "KeyError: 'boom'"), ("d", "no text"), ("e", "no chunks")]
    parents, children = found.parents(), found.children()
    assert {r["file_id"] for r in parents.collect()} == {r["file_id"] for r in children.collect()} == {"a", "c", "f", None}
    tens = parents.where("file_id = 'a' and file_extension = '.py'").orderBy("parent_index").collect()
    assert len(tens) == 41 and tens[0]["text"] == " ".join(["word"] * 10) and tens[0]["header_1"] == "python" and tens[3]["text_splitters"] == ["Tens"]
    assert children.where("file_id = 'a'").first()["text_splitters"] == ["Tens", C.CHILD_SPLITTER]
    summary = {(r["file_id"], r["parent_count"]): r for r in found.summary().collect()}
    assert summary[("a", 41)]["splitter"] == "Tens" and len(set(summary[("a", 41)]["parent_ids"])) == 41 and summary[("a", 41)]["document_loader"] == "TextLoader"
    assert set(summary[("a", 41)]["parent_ids"]) == {r["parent_id"] for r in tens}
    assert summary[("a", 41)]["children_count"] == children.where("file_id = 'a' and file_extension = '.py'").count()
    assert summary[("b", 0)]["error"] and summary[("b", 0)]["children_count"] == 0 and summary[("d", 0)]["text_length"] is None and summary[("b", 0)]["seconds"] >= 0
    with pytest.raises(ValueError):
        registry.register(L.Splitter("Tens", (".x",), words_of_ten))


def test_order_of_splitters():
    first, second = L.Splitter("first", (".a", ".b"), words_of_ten, 5), L.Splitter("second", ("*",), words_of_ten, 5)
    registry = L.Registry().register(first).register(second).register(L.Splitter("early", (".b",), words_of_ten, 1))
    assert [registry.chosen(e).name for e in (".a", ".b", ".c", None)] == ["first", "early", "second", "second"]
    assert L.Registry().register(first).chosen(".c") is None
    assert [L.STANDARD.chosen(e).name for e in (".md", ".htm", ".py", ".txt")] == ["MarkdownTextSplitterAdapter", "HTMLTextSplitterAdapter", "CodeTextSplitter", "UniversalTextSplitter"]


def test_publishing_counts_the_refused(spark, tmp_path):
    registry = L.Registry().register(L.Splitter("Tens", ("*",), words_of_ten))
    good = L.load(files(spark, [("a", ".x", "some words here"), ("b", ".x", "boom")]), registry)
    good.published(str(tmp_path), "one", most_rejected=0.5)
    assert {r["file_id"] for r in T.published(spark, str(tmp_path), "children").collect()} == {"a"}
    assert T.published(spark, str(tmp_path), "rejects").first()["file_id"] == "b"
    bad = L.load(files(spark, [("b", ".x", "boom")]), registry)
    with pytest.raises(ValueError, match="1 of 1"):
        bad.published(str(tmp_path), "two", most_rejected=0.5)
    assert {r["file_id"] for r in T.published(spark, str(tmp_path), "parents").collect()} == {"a"}
    L.load(files(spark, [("c", ".x", "later")]), registry).published(str(tmp_path), "a version that sorts first")
    assert {r["file_id"] for r in T.published(spark, str(tmp_path), "parents").collect()} == {"c"}


def test_empty_table(spark):
    none = L.load(files(spark, []))
    assert (none.files, none.rejected) == (0, 0) and none.parents().count() == none.children().count() == none.rejects().count() == 0


def test_long_file(spark):
    found = L.load(files(spark, [("a", ".md", "# Title\n" + "Some words in a line.\n\n" * 20_000)]))
    rows = found.parents().orderBy("parent_index").collect()
    assert [r["parent_index"] for r in rows] == list(range(len(rows))) and all(len(r["text"]) <= C.PARENT_SIZE for r in rows) and len(rows) > 400
