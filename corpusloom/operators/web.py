"""Main content and metadata of web pages: blocks from a stack of open tags, chosen by region, text and links.

One pass over a page's characters and one over its blocks; pages stream through in Arrow batches, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template nav footer header aside form button select textarea svg iframe object head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What an element ends when it begins: the left ones cannot hold the right ones.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements inside which such an end does not reach further out.
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class or id that mark what is not content.
ASIDES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|banner|breadcrumbs?|cookie|menu|navbar|newsletter|popup|promo|related|share|sharing|sidebar|social|sponsor)(?:$|[\s_-])", re.I)
# Where pages state author and date, best first.
AUTHOR = ("author", "article:author", "dc.creator", "dcterms.creator", "parsely-author")
DATE = ("article:published_time", "datepublished", "date", "dc.date", "dcterms.date", "pubdate", "publish-date", "og:published_time")
#: A block with a larger part of its text in links is a list of links.
MOST_LINKED = 0.5
#: Without an article or main element: what a block must have to count for the content, and what a link costs.
LEAST_TEXT, LINK_COST = 25, 3

FIELDS = "title string, author string, date string, lang string, description string, site string, url string, text string, markdown string, links array<struct<text:string,href:string>>"


@dataclass
class Block:
    """A run of text without a block boundary in it."""

    kind: str
    region: int  # 2 in an article, 1 in a main element, else 0
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: list[tuple[str, str]] = field(default_factory=list)
    marked: list[str] = field(default_factory=list)

    def text(self, pieces: list[str]) -> str:
        whole = "".join(pieces)
        if self.kind == "pre":
            return whole.strip("\n")
        lines = (" ".join(line.split()) for line in whole.split("\x00"))
        return "\n".join(line for line in lines if line)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, str]] = [("", False, 0, "")]  # tag, hidden, region, kind of the blocks in it
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.link: tuple[str, list[str]] | None = None
        self.facts: dict[str, str] = {}
        self.title: list[str] = []
        self.data: list[str] = []

    # A block begins with the first text in it and ends at the next boundary.

    def boundary(self) -> None:
        self.finish_link()
        self.block = None

    def current(self) -> Block:
        if self.block is None:
            self.block = Block(self.stack[-1][3], self.stack[-1][2])
            self.blocks.append(self.block)
        return self.block

    def finish_link(self) -> None:
        if self.link and self.block is not None:
            href, words = self.link
            text = " ".join("".join(words).split())
            if text:
                self.block.links.append((text, href))
                self.block.marked.append(f"[{text}]({href})")
        self.link = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        self.note(tag, given)
        if tag in VOID:
            if tag == "br" and not self.stack[-1][1] and self.block is not None:
                self.add("\x00")
            elif tag == "hr":
                self.boundary()
            return
        if tag in BLOCKS and self.open["p"]:
            self.end("p")
        for name in ENDS.get(tag, ()):
            if self.open[name]:
                self.end(name, FENCES[tag])
        if tag in BLOCKS:
            self.boundary()
        _, hidden, region, kind = self.stack[-1]
        region = {"article": 2, "main": max(region, 1)}.get(tag, region)
        if tag == "header" and region == 2:  # an article's own header holds its title
            hides = False
        else:
            hides = tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or bool(ASIDES.search(f"{given.get('class', '')} {given.get('id', '')}"))
        kind = "tr" if tag in ("td", "th") else tag if tag in BLOCKS else kind
        self.stack.append((tag, hidden or (hides and tag not in ("html", "body", "article", "main")), region, kind))
        self.open[tag] += 1
        if tag in ("td", "th") and self.block is not None and not self.stack[-1][1]:
            self.finish_link()
            self.add(" | ")
        if tag == "a" and given.get("href") and not self.stack[-1][1]:
            self.finish_link()
            self.link = (given["href"], [])

    def end(self, tag: str, fences: tuple[str, ...] = ()) -> None:
        """End the innermost ``tag`` and what is open in it, unless a fence comes first."""
        for name, *_ in reversed(self.stack):
            if name in fences:
                return
            if name == tag:
                break
        while True:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if name in BLOCKS:
                self.boundary()
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.finish_link()
        if tag in BLOCKS:
            self.boundary()
        if self.open[tag]:
            self.end(tag)

    def add(self, text: str) -> None:
        block = self.current()
        block.pieces.append(text)
        if self.link:
            self.link[1].append(text)
            block.linked += len("".join(text.split()))
        else:
            block.marked.append(text)

    def handle_data(self, data: str) -> None:
        tag, hidden, *_ = self.stack[-1]
        if tag == "title":
            self.title.append(data)
        elif tag == "script":
            self.data.append(data)
        elif not hidden and (self.block is not None or data.strip()):
            self.add(data if tag == "pre" else data.replace("\x00", " "))

    def note(self, tag: str, given: dict[str, str]) -> None:
        """Facts that tags state; the first one counts."""
        if tag == "meta":
            for name in (given.get("property"), given.get("name"), given.get("itemprop")):
                if name and given.get("content", "").strip():
                    self.facts.setdefault(name.lower(), given["content"].strip())
        elif tag == "html" and "lang" in given:
            self.facts.setdefault(" lang", given["lang"])
        elif tag == "link" and given.get("rel", "").lower() == "canonical":
            self.facts.setdefault(" url", given.get("href", ""))
        elif tag == "time" and given.get("datetime"):
            self.facts.setdefault(" time", given["datetime"])


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks of the content: those of articles, else of main elements, without lists of links. A page that has
    neither gives the run of blocks whose text, less a little for each block and more for links, adds up to the most."""
    held = [(b, len("".join("".join(b.pieces).split()))) for b in blocks]
    held = [(b, n) for b, n in held if n]
    best = max((b.region for b, _ in held), default=0)
    if best:
        return [b for b, n in held if b.region == best and b.linked <= MOST_LINKED * n]
    most, total, start, span = 0, 0, 0, (0, 0)
    for i, (b, n) in enumerate(held):
        if total <= 0:
            total, start = 0, i
        total += n - LINK_COST * b.linked - LEAST_TEXT
        if total > most:
            most, span = total, (start, i + 1)
    return [b for b, n in held[slice(*span)] if b.linked <= MOST_LINKED * n]


def as_date(value: str) -> str | None:
    """A stated date as second-exact text without a zone; null where it is none."""
    value = value.strip()
    for form in (lambda v: datetime.fromisoformat(v), lambda v: datetime.strptime(v[:10].replace("/", "-"), "%Y-%m-%d")):
        try:
            return form(value).replace(tzinfo=None, microsecond=0).isoformat()
        except ValueError:
            continue
    return None


def _markdown(block: Block) -> str:
    text = block.text(block.marked)
    if block.kind == "tr":
        return f"| {text} |"
    mark = {"li": "- ", "blockquote": "> ", **{f"h{n}": "#" * n + " " for n in range(1, 7)}}.get(block.kind, "")
    return f"```\n{text}\n```" if block.kind == "pre" else mark + text


def read_page(html: str) -> dict:
    """The columns of ``FIELDS`` for one page; what a page does not state is null."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.boundary()
    facts, scripts = reader.facts, "".join(reader.data)
    stated = lambda names: next((facts[n] for n in names if n in facts), None)
    linked = lambda name: (found := re.search(rf'"{name}"\s*:\s*(?:\{{[^{{}}]*?"name"\s*:\s*)?"([^"]*)"', scripts)) and found[1]
    content = chosen(reader.blocks)
    dates = (as_date(d) for d in (*(facts.get(n) for n in DATE), linked("datePublished"), facts.get(" time")) if d)
    first = next((b.text(b.pieces) for b in content if b.kind == "h1"), None)
    return {
        "title": " ".join("".join(reader.title).split()) or facts.get("og:title") or first, "author": stated(AUTHOR) or linked("author"), "date": next((d for d in dates if d), None),
        "lang": facts.get(" lang"), "description": stated(("description", "og:description")), "site": facts.get("og:site_name"), "url": facts.get(" url") or facts.get("og:url"),
        "text": "\n".join(b.text(b.pieces) for b in content) or None, "markdown": "\n\n".join(map(_markdown, content)) or None,
        "links": [{"text": t, "href": h} for b in content for t, h in b.links],
    }


def page_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the columns of ``FIELDS`` in place of the page itself. A null page has nulls and no links."""
    others = [c for c in pages.columns if c != html]
    out = T.StructType([*[pages.schema[c] for c in others], *T.StructType.fromDDL(FIELDS).fields])
    link = pa.struct([("text", pa.string()), ("href", pa.string())])
    names = [f.name for f in T.StructType.fromDDL(FIELDS).fields]
    nothing = {**dict.fromkeys(names), "links": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [nothing if page is None else read_page(page) for page in batch.column(html).to_pylist()]
            made = [pa.array([r[n] for r in read], pa.list_(link) if n == "links" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, *names])

    return pages.select(*others, html).mapInArrow(run, out)
