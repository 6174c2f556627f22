"""Web pages: nested, unclosed and table markup, what is content, and what pages state of themselves."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import web

PAGE = """<!doctype html><html lang="de"><head><title> A &amp; B
 </title><meta name="Author" content="Jo Doe"><meta property="article:published_time" content="2024-03-05T10:20:30+02:00">
<meta property="og:site_name" content="Site"><link rel="canonical" href="https://x.example/a"></head>
<body><nav><a href="/">Home</a></nav><div class="cookie banner">We use cookies</div>
<main>outside<article><header><h1>Top <em>title</em></h1></header>
<p>First <a href="/one">link one</a> and text that goes on.<p>Second, unclosed &lt;b&gt;
<ul><li>one<li>two <b>bold<ul><li>inner</ul><li>three</ul>
<table><tr><th>Name<th>Size<tr><td>a</td><td><a href="/b">b</a></td></tr></table>
<pre>  x = 1
    y = 2
</pre><blockquote>Said so.</blockquote>
<p><a href="/r1">Related one</a> <a href="/r2">Related two</a></p>
<aside>aside</aside><script>var p = "<p>no</p>";</script><div hidden>hidden</div><footer>foot</footer></article></main>
<footer>bottom</footer>"""


def test_whole_page():
    got = web.read_page(PAGE)
    assert got["text"].split("\n") == ["Top title", "First link one and text that goes on.", "Second, unclosed <b>", "one", "two bold", "inner", "three", "Name | Size", "a | b", "  x = 1", "    y = 2", "Said so."]
    assert "Related" not in got["text"] and "aside" not in got["text"] and "outside" not in got["text"] and "cookies" not in got["text"]
    assert got["title"] == "A & B" and got["author"] == "Jo Doe" and got["date"] == "2024-03-05T10:20:30" and got["lang"] == "de"
    assert got["site"] == "Site" and got["url"] == "https://x.example/a" and got["description"] is None
    assert {"text": "link one", "href": "/one"} in got["links"]
    lines = got["markdown"].split("\n\n")
    assert lines[0] == "# Top title" and lines[1] == "First [link one](/one) and text that goes on." and "- two bold" in lines and "> Said so." in lines
    assert "| Name | Size |" in lines and "```\n  x = 1\n    y = 2\n```" in lines


@pytest.mark.parametrize(
    "html, lines",
    [
        ("<article><p>a<p>b</p></div>c</article>", ["a", "b", "c"]),
        ("<article><div>a<div>b<span>c</div>d</div>e", ["a", "bc", "d", "e"]),
        ("<article><table><tr><td>1<td>2<tr><td><table><tr><td>in</td></tr></table></td><td>3</table>", ["1 | 2", "in", "3"]),
        ("<article>one<br>two<br/><br>three</article>", ["one", "two", "three"]),
        ("<article><b>x<i>y</b>z</i></article>", ["xyz"]),
        ("<article>a<article>b</article>c</article>", ["a", "b", "c"]),
        ("<article><p>un<unknown>known</unknown> &nbsp;&copy;</p></article>", ["unknown ©"]),
        ("<article><p>a page that was cut <a href='x'>in a link", ["a page that was cut in a link"]),
        ("<article><!-- <p>no</p> --><p>yes</p><noscript>no</noscript></article>", ["yes"]),
        ("<main><p>main</p></main><p>not this</p>", ["main"]),
        ("plain text without any tag at all, of some length", ["plain text without any tag at all, of some length"]),
    ],
)
def test_markup(html, lines):
    assert (web.read_page(html)["text"] or "").split("\n") == lines


def test_content_without_a_region():
    """The run of full blocks is kept, short and linked ones around it are not."""
    menu = "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(12))
    body = "".join(f"<p>Paragraph {i} with quite some words in it, so that it counts as text of the page.</p>" for i in range(4))
    got = web.read_page(f"<body><div>Short</div><ul>{menu}</ul><h2>Head of text that counts</h2>{body}<p>Ok.</p><ul>{menu}</ul><p>©</p></body>")
    assert got["text"].count("Paragraph") == 4 and "Menu" not in got["text"] and "Short" not in got["text"] and "©" not in got["text"]
    assert web.read_page("<body><ul><li><a href='/'>only links</a></ul></body>")["text"] is None
    assert web.read_page("")["text"] is None


def best_run(blocks):
    """Every run by brute force: the largest sum, the first of several, without links lists in it."""
    value = lambda b: len("".join("".join(b.pieces).split())) - web.LINK_COST * b.linked - web.LEAST_TEXT
    runs = [(sum(map(value, blocks[i:j])), i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)]
    return max((total for total, _, _ in runs if total > 0), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 20)), max_size=12))
def test_run_is_the_best_one(sizes):
    blocks = [web.Block("p", 0, ["x" * n], min(linked, n)) for n, linked in sizes]
    value = lambda b: len(b.pieces[0]) - web.LINK_COST * b.linked - web.LEAST_TEXT
    kept = web.chosen(blocks)
    assert all(b.linked <= web.MOST_LINKED * len(b.pieces[0]) for b in kept)
    best = best_run(blocks)
    if not best:
        assert kept == []
    else:
        places = [next(i for i, b in enumerate(blocks) if b is k) for k in kept]
        span = blocks[places[0] : places[-1] + 1]
        assert sum(map(value, span)) <= best <= sum(value(b) for b in span if value(b) > 0)


@pytest.mark.parametrize(
    "head, author, date",
    [
        ('<script type="application/ld+json">{"author": {"@type": "Person", "name": "Ann"}, "datePublished": "2023-01-02"}</script>', "Ann", "2023-01-02T00:00:00"),
        ('<script type="application/ld+json">{"author":"Bob","datePublished":"2023-01-02T03:04:05Z"}</script>', "Bob", "2023-01-02T03:04:05"),
        ('<meta name="dc.date" content="2020/07/08">', None, "2020-07-08T00:00:00"),
        ('<meta name="date" content="soon"><meta name="author" content=" ">', None, None),
        ('<meta itemprop="datePublished" content="2021-05-06 07:08"><meta name="date" content="2000-01-01">', None, "2021-05-06T07:08:00"),
    ],
)
def test_author_and_date(head, author, date):
    got = web.read_page(f"<html><head>{head}</head><body><article><p>x</p><time datetime=''>now</time></article></body></html>")
    assert (got["author"], got["date"]) == (author, date)
    later = web.read_page("<article><time datetime='2019-02-03'>then</time><p>x</p></article>")
    assert later["date"] == "2019-02-03T00:00:00"


def test_time_grows_with_the_page():
    """Unclosed and unmatched tags by the thousand: ten times the page takes about ten times as long, not a hundred."""
    def taken(n):
        pages = ["<article>" + "<div><p>text<span>" * n, "<article>" + "<b>x</i></div>" * n, "<article><table>" + "<tr><td>1<td>2" * n]
        begun = time.perf_counter()
        for page in pages:
            web.read_page(page)
        return time.perf_counter() - begun

    taken(200)
    assert taken(20_000) < 40 * max(taken(2_000), 0.01)


def test_table_of_pages(spark):
    rows = [(1, PAGE, "x"), (2, None, "y"), (None, "", None), (1, PAGE, "x")]
    got = web.page_content(spark.createDataFrame(rows, "page_id long, html string, url2 string")).collect()
    assert [r["page_id"] for r in got] == [1, 2, None, 1] and got[0]["links"][0]["href"] == "/one" and got[1]["text"] is None and got[1]["links"] == []
    assert web.page_content(spark.createDataFrame([], "page_id long, html string")).count() == 0
