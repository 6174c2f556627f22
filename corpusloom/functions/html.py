"""Main-content extraction from raw web pages with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# Elements that never hold main content.
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "noscript", "form")
# Entities decoded after tags are gone (ampersand last).
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"),
    ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"),
)


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def without_boilerplate(html: Column) -> Column:
    """Drop comments, boilerplate elements and advert blocks, tags and content alike."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in BOILERPLATE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return F.regexp_replace(html, r'(?is)<div class="ad"[^>]*>.*?</div\s*>', "")


def strip_tags(html: Column) -> Column:
    """Text of a fragment: block ends become line ends, other tags vanish, entities are decoded."""
    html = F.regexp_replace(html, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|ul|ol|table|article|section)\s*>", "\n")
    html = unescape(F.regexp_replace(html, r"(?s)<[^>]*>", ""))
    html = F.regexp_replace(html, r"[ \t]+", " ")
    return strip(F.regexp_replace(html, r" ?\n[ \n]*", "\n"))


def title(html: Column) -> Column:
    return unescape(strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1)


def main_fragment(html: Column) -> Column:
    """The ``article`` element, else ``main``; null where a page has neither."""
    cleaned = without_boilerplate(html)
    article = F.regexp_extract(cleaned, r"(?is)<article[^>]*>(.*)</article>", 1)
    main = F.regexp_extract(cleaned, r"(?is)<main[^>]*>(.*)</main>", 1)
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(main, F.lit("")))


def body_fragment(html: Column) -> Column:
    """The body without boilerplate; a page with no body tag, or an unclosed one, is kept whole."""
    html = F.regexp_replace(without_boilerplate(html), r"(?is)<head(\s[^>]*)?>.*?</head\s*>", "")
    html = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    return F.regexp_replace(html, r"(?is)</body\s*>.*$", "")


def main_text(html: Column) -> Column:
    return F.nullif(strip_tags(main_fragment(html)), F.lit(""))


def body_text(html: Column) -> Column:
    """Plain variant: everything in the body, boilerplate removed, no content heuristics."""
    return F.nullif(strip_tags(body_fragment(html)), F.lit(""))


def to_markdown(html: Column) -> Column:
    """Headings of the body as markdown lines, the rest as plain text lines."""
    body = F.regexp_replace(body_fragment(html), r"\s*\n\s*", " ")
    for level in (1, 2, 3):
        body = F.regexp_replace(body, rf"(?is)<h{level}[^>]*>(.*?)</h{level}\s*>", "\n" + "#" * level + " $1\n")
    return strip_tags(body)
