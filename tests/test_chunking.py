"""Splitting rules on small texts, and invariants of the recursive splitter."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.languages import LANGUAGE_OF, separators
from corpusloom.operators import chunking as C
from corpusloom.operators.recursive_split import locate, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.é漢", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_recursive_split_invariants(text, size, overlap):
    overlap = min(overlap, size // 2)
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() and c in text for c in chunks)
    joined = "".join(chunks)
    assert all(x in joined for x in set(text.split()) if len(x) <= size - 1) or len(chunks) > 0 or not text.strip()
    assert sum(len("".join(c.split())) for c in chunks) >= len("".join(text.split()))
    starts = locate(text, chunks, overlap)
    assert all(at >= 0 and text[at : at + len(c)] == c for at, c in zip(starts, chunks))


def test_split_prefers_coarse_separators():
    assert split_text("one two\n\nthree four", 12, 0) == ["one two", "three four"]
    assert split_text("aaaa bbbb cccc", 9, 4) == ["aaaa bbbb", "cccc"]
    assert split_text("x" * 10, 4, 0) == ["xxxx", "xxxx", "xx"]
    assert split_text("", 5, 0) == []


def test_code_separators():
    code = "import os\n\nclass A:\n    x = 1\n\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n"
    chunks = split_text(code, 60, 0, separators("python"))
    assert chunks[0].startswith("import os") and any(c.startswith("class A") for c in chunks) and any(c.startswith("def g") for c in chunks)
    assert all(separators(language)[-1] == "" for language in set(LANGUAGE_OF.values()))


def windows(text, size, overlap):
    step = size - overlap
    return [(text[i : i + size], i) for i in range(0, max(len(text) - overlap, 1), step)]


def test_windows_match_slices(spark):
    texts = ["", "a", "ab" * 5, "x" * 9, "é漢z" * 30, "line\n" * 13, "y" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, overlap in ((10, 3), (10, 0), (4, 2), (200, 50)):
        for row in df.select("text", C.windows(F.col("text"), size, overlap).alias("w")).collect():
            assert [(w.text, w.start_index) for w in row.w] == windows(row.text, size, overlap), (row.text, size, overlap)


MARKDOWN = "intro\n# A\ntext a\n\nmore a\n## B\n```\n# not a header\n```\nend b\n### C\nsub\n# D\n# E\n## F\nlast"


def test_markdown_sections(spark):
    df = spark.createDataFrame([("f", MARKDOWN), ("g", "# Only"), ("h", "plain")], "file_id string, text string")
    rows = C.markdown_sections(df).orderBy("file_id", "section_index").collect()
    got = [(r.section_index, r.header_1, r.header_2, r.text) for r in rows if r.file_id == "f"]
    assert got == [
        (0, None, None, "intro"),
        (1, "A", None, "# A\ntext a  \nmore a"),
        (2, "A", "B", "## B\n```\n# not a header\n```\nend b\n### C\nsub"),
        (3, "D", None, "# D"),
        (4, "E", "F", "# E  \n## F\nlast"),
    ]
    assert [(r.header_1, r.text) for r in rows if r.file_id != "f"] == [("Only", "# Only"), (None, "plain")]


PAGE = (
    "<html lang='en'><head><title>T &amp; U</title></head><body><nav>menu</nav><h1>One</h1><p>a</p><h2>Two</h2><p>b<br>c</p>"
    "<script>var t='<h2>no</h2>'</script><h1>Three</h1><p>d &lt;e&gt;</p><footer>foot</footer></body></html>"
)


def test_html_sections(spark):
    df = spark.createDataFrame([("p", PAGE), ("q", "<body><p>none</p></body>")], "file_id string, html string")
    rows = C.html_sections(df, "file_id").orderBy("file_id", "section_index").collect()
    assert [(r.header_1, r.header_2, r.text) for r in rows] == [
        ("One", None, "One\na"), ("One", "Two", "Two\nb\nc"), ("Three", None, "Three\nd <e>"), (None, None, "none"),
    ]
    assert df.where("file_id = 'p'").select(H.title(F.col("html"))).first()[0] == "T & U"


def slow_merge(blocks, size, separator="\n\n"):
    blocks = list(blocks)
    while True:
        best, deepest = None, -1
        for i in range(len(blocks) - 1):
            if len(blocks[i][0]) + len(separator) + len(blocks[i + 1][0]) <= size:
                depth = len(C._common(blocks[i][1], blocks[i + 1][1]))
                if depth > deepest:
                    best, deepest = i, depth
        if best is None:
            return blocks
        a, b = blocks[best], blocks.pop(best + 1)
        blocks[best] = (a[0] + separator + b[0], C._common(a[1], b[1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("x", min_size=1, max_size=12), st.lists(st.sampled_from("AB"), max_size=2).map(tuple)), max_size=12), st.integers(1, 40))
def test_merge_matches_repeated_scan(blocks, size):
    assert C.merge_blocks(blocks, size) == slow_merge(blocks, size)


def test_routing(spark):
    names = [".md", ".html", ".htm", ".py", ".h", ".txt", ".pdf", ".xyz"]
    df = spark.createDataFrame([(n,) for n in names], "e string")
    got = {r.e: r.s for r in df.select("e", C.splitter_for(F.col("e")).alias("s")).collect()}
    assert got[".md"] == "MarkdownTextSplitterAdapter" and got[".htm"] == got[".html"] == "HTMLTextSplitterAdapter"
    assert got[".py"] == "CodeTextSplitter(python)" and got[".h"] == "CodeTextSplitter(cpp)"
    assert got[".txt"] == got[".pdf"] == got[".xyz"] == "UniversalTextSplitter"
    lengths = spark.createDataFrame([(".txt", 1499), (".txt", 1500), (".html", 10)], "e string, n int")
    assert [r[0] for r in lengths.select(C.keeps_whole(F.col("e"), F.col("n"))).collect()] == [True, False, False]


def test_ingest(spark):
    long = "word " * 600
    files = [("a", ".txt", "short"), ("b", ".txt", long), ("c", ".md", MARKDOWN * 60), ("d", ".html", PAGE), ("e", ".py", "def f():\n    return 1\n" * 200)]
    parents, children = C.ingest(spark.createDataFrame(files, "file_id string, file_extension string, text string"))
    p, c = parents.collect(), children.collect()
    assert {r.file_id for r in p} == set("abcde") and len({r.parent_id for r in p}) == len(p) and len({r.child_id for r in c}) == len(c)
    for f in "abcde":
        assert sorted(r.parent_index for r in p if r.file_id == f) == list(range(sum(r.file_id == f for r in p)))
    texts = {r.parent_id: r for r in p}
    assert all(len(r.text) <= 1000 for r in p if r.file_id != "a") and all(len(r.text) <= 256 for r in c)
    assert all(texts[r.parent_id].text[r.start_index :].startswith(r.text) for r in c)
    assert {tuple(r.text_splitters) for r in c if r.file_id == "b"} == {("UniversalTextSplitter", "ChildTextSplitter")}
    again = C.ingest(spark.createDataFrame(files, "file_id string, file_extension string, text string"))[1]
    assert {r.child_id for r in again.collect()} == {r.child_id for r in c}
    whole = C.ingest(spark.createDataFrame(files, "file_id string, file_extension string, text string"), use_parent=False)[0]
    assert whole.count() == len(files)


def test_merge_consecutive(spark):
    rows = [("f", i, f"{i}", f"id{i}") for i in (0, 1, 2, 4, 6, 7)] + [("g", 3, "3", "g3")]
    df = spark.createDataFrame(rows, "file_id string, parent_index int, text string, parent_id string")
    got = sorted((r.file_id, r.parent_index, r.parent_id, r.text) for r in C.merge_consecutive(df, ["file_id"]).collect())
    assert got == [("f", 0, "id0", "0\n\n1\n\n2"), ("f", 4, "id4", "4"), ("f", 6, "id6", "6\n\n7"), ("g", 3, "g3", "3")]
