"""Column expressions over text: normalising, tokenising, sentence splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words dropped before term matching.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)

WORD = r"[\p{L}\p{N}]+"
HAN = r"\p{IsHan}"
HAN_OR_WORD = rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"


# Fixed value: characters that count as white space at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column | str) -> Column:
    """Text without white space at its ends; unlike ``trim`` alone this includes line ends."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    """A struct whose field names also hold inside lambdas, where aliases may be cleaned away."""
    return F.named_struct(*[x for name, col in fields.items() for x in (F.lit(name), col)])


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def or_missing(text: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased words; runs of Han characters become character bigrams."""
    lowered = F.lower(text)
    plain = F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1)

    def bigrams(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(run, i, F.lit(2)))

    mixed = F.flatten(
        F.transform(
            F.regexp_extract_all(lowered, F.lit(f"({HAN_OR_WORD})"), 1),
            lambda run: F.when(run.rlike(f"^{HAN}"), bigrams(run)).otherwise(F.array(run)),
        )
    )
    return F.when(text.rlike(HAN), mixed).otherwise(plain)


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS, min_length: int = 2) -> Column:
    """Index terms of a text: words without stop words and without one-character words."""
    return F.filter(words(text), lambda t: (F.length(t) >= min_length) & ~t.isin(*stop_words))


def sentences(text: Column) -> Column:
    """Sentences of a text, cut after ``.``, ``!`` or ``?`` and at line ends; blanks dropped."""
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: strip(s) != "")


def suffix(path: Column) -> Column:
    """File extension with its dot, or an empty string."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def hash_unit(seed: str, *parts: Column) -> Column:
    """A reproducible uniform number in (0, 1) drawn from the md5 of a seed and a row's key."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def hash_key(seed: str, *parts: Column) -> Column:
    """A reproducible sort key for random orders."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
