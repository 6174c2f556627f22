"""Licence scans by sentence rules: known sentences become identifiers, and rules match sequences of identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What the sentences of public licence notices say, as patterns over normalised sentences (lower case,
# words of letters, digits, dots and hyphens, one blank between). A name stands in a rule; the first pattern that fits wins.
SPDX = "spdx license identifier"
#: Licence of an SPDX identifier, by a pattern for the identifier in lower case.
SPDX_IDS: tuple[tuple[str, str, str], ...] = (
    ("spdx_apache2", "Apache-2.0", r"apache-2\.0"),
    ("spdx_mit", "MIT", r"mit"),
    ("spdx_bsd3", "BSD-3-Clause", r"bsd-3-clause"),
    ("spdx_bsd2", "BSD-2-Clause", r"bsd-2-clause"),
    ("spdx_gpl3_later", "GPL-3.0-or-later", r"gpl-3\.0-or-later"),
    ("spdx_gpl2_later", "GPL-2.0-or-later", r"gpl-2\.0-or-later"),
    ("spdx_gpl3", "GPL-3.0-only", r"gpl-3\.0(-only)?"),
    ("spdx_gpl2", "GPL-2.0-only", r"gpl-2\.0(-only)?"),
    ("spdx_cc_by_nc_sa", "CC-BY-NC-SA", r"cc-by-nc-sa-\d\.\d"),
    ("spdx_cc_by_nc", "CC-BY-NC", r"cc-by-nc-\d\.\d"),
    ("spdx_cc_by_sa", "CC-BY-SA", r"cc-by-sa-\d\.\d"),
    ("spdx_cc_by", "CC-BY", r"cc-by-\d\.\d"),
    ("spdx_cc0", "CC0-1.0", r"cc0-1\.0"),
    ("spdx_mpl2", "MPL-2.0", r"mpl-2\.0"),
)
SENTENCES: tuple[tuple[str, str], ...] = (
    *((name, rf"^{SPDX} {pattern}$") for name, _, pattern in SPDX_IDS),
    ("spdx", rf"^{SPDX}\b"),
    ("apache2", r"\blicensed under the apache[ -]license,? version 2(\.0)?\b"),
    ("apache_copy", r"^you may obtain a copy of the license at\b"),
    ("apache_use", r"^you may not use this file except in compliance with the license\b"),
    ("as_is", r"\b(is )?(provided|distributed) (by .* )?(on an )?as is\b"),
    ("mit_name", r"\breleased under the mit license\b|\blicensed under the mit license\b|^(the )?mit license\b"),
    ("mit_grant", r"^permission is hereby granted,? free of charge,? to any person obtaining a copy\b"),
    ("mit_notice", r"^the above copyright notice and this permission notice shall be included\b"),
    ("bsd_grant", r"^redistribution and use in source and binary forms\b"),
    ("bsd_source", r"^redistributions of source code must retain\b"),
    ("bsd_binary", r"^redistributions in binary form must reproduce\b"),
    ("bsd_endorse", r"^neither the name of\b"),
    ("gpl3", r"\blicensed under the gnu general public license,? version 3\b"),
    ("gpl2", r"\blicensed under the gnu general public license,? version 2\b"),
    ("gpl_free", r"^this program is free software\b"),
    ("gpl_v3", r"\beither version 3 of the license\b"),
    ("gpl_v2", r"\beither version 2 of the license\b"),
    ("or_later", r"\bor at your option any later version\b"),
    ("cc_by_nc_sa", r"\bcc[ -]by[ -]nc[ -]sa[ -]\d(\.\d)?\b"),
    ("cc_by_nc", r"\bcc[ -]by[ -]nc[ -]\d(\.\d)?\b"),
    ("cc_by_sa", r"\bcc[ -]by[ -]sa[ -]\d(\.\d)?\b"),
    ("cc_by", r"\bcc[ -]by[ -]\d(\.\d)?\b"),
    ("cc0", r"\bcc0\b"),
    ("mpl2", r"\bmozilla public license,? v(ersion|\.)? ?2(\.0)?\b"),
    ("copyright", r"^copyright\b.*\b\d{4}\b"),
    ("reserved", r"^all rights reserved\b"),
)


@dataclass(frozen=True)
class Rule:
    """A licence, and the identifiers that must follow each other for it; ``gap`` others may stand between two."""

    licence: str
    names: tuple[str, ...]
    gap: int = 2


# Ordered: a rule claims its sentences, and later rules see only what is left.
RULES: tuple[Rule, ...] = (
    Rule("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    Rule("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    Rule("MIT", ("mit_grant", "mit_notice")),
    Rule("GPL-3.0-or-later", ("gpl_free", "gpl_v3")),
    Rule("GPL-2.0-or-later", ("gpl_free", "gpl_v2")),
    Rule("Apache-2.0", ("apache2", "apache_use", "apache_copy")),
    Rule("Apache-2.0", ("apache2",)),
    Rule("MIT", ("mit_name",)),
    Rule("MIT", ("mit_grant",)),
    Rule("GPL-3.0-only", ("gpl3",)),
    Rule("GPL-2.0-only", ("gpl2",)),
    Rule("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    Rule("CC-BY-NC", ("cc_by_nc",)),
    Rule("CC-BY-SA", ("cc_by_sa",)),
    Rule("CC-BY", ("cc_by",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("MPL-2.0", ("mpl2",)),
    Rule("proprietary", ("reserved",)),
    *(Rule(licence, (name,)) for name, licence, _ in SPDX_IDS),
)

#: A sentence can only be known when it holds one of these; in a text their words may stand on two lines.
HINT = r"(?i)licen[sc]e|copyright|permission|redistribution|neither\W+the\W+name|rights\W+reserved|as\W+is\b|spdx|free\W+software|cc\W*by|cc0|later\W+version"

# A line goes on with the sentence of the line before, except where it begins like a list item or a notice: those of
# the patterns that ask for the start of a sentence, those that are a name only, and lines that say "licensed under".
_BEGINS = (
    r"(?:\(?(?:\d{1,2}|[a-z])[.)]|[-*•])[ \t]+\S|copyright[ \t]*(?:\(c\)|©|\d{4})|(?:the )?mit license\b|permission is hereby granted|"
    r"the above copyright notice and this|redistributions? (?:and use|of source|in binary)|neither the name of|this program is free software|"
    r"you may (?:obtain a copy|not use this file)|all rights reserved|mozilla public license|cc[ -]by|cc0|[^\n]*\b(?:licensed|released) under\b"
)
_CUT = r"(?i)(?<=[.;:!?])(?<!\bv\.)\s+|\n[ \t]*\n|(?<!version)(?<!\bv\.)\n(?=[ \t]*(?:" + _BEGINS + "))"


def normalised_sentences(text: Column) -> Column:
    """Sentences in lower case, cut after full stops (not inside version numbers or after ``v.``), semicolons and colons, at
    blank lines, and before lines that begin a list item or a notice. Wrapped lines are joined; list marks go. Each
    identifier of an SPDX line is a sentence of its own.
    """
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[ \t]*(#|//|/\*|\*/|\*|--)+[ \t]?|[ \t]+$", "")
    later = F.regexp_replace(lines, r"(?i)\b(?<!-)(GPL-[23]\.0)\+", "$1-or-later")
    joined = F.regexp_replace(later, r"(?i)\bspdx-license-identifier[ \t]*:[ \t]*([^\n]*)", f"\n\n{SPDX} $1\n\n")
    bare = F.transform(F.split(joined, _CUT), lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]*(?:(?:\d{1,2}|[A-Za-z])\)[^\p{L}\p{N}]*)?", ""))
    clean = F.transform(bare, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N},.\-]+", " ")))
    whole = F.transform(clean, lambda s: F.regexp_replace(s, r"[ .,\-]+$", ""))
    single = lambda s: F.transform(F.split(F.substring(s, len(SPDX) + 2, 1 << 30), r" (?:or|and|with) "), lambda x: F.concat(F.lit(f"{SPDX} "), x))
    each = F.flatten(F.transform(whole, lambda s: F.when(s.startswith(f"{SPDX} "), single(s)).otherwise(F.array(s))))
    return F.filter(each, lambda s: ~s.rlike(r"^(\d{1,2}|[a-z])?$"))


def identifiers(text: Column) -> Column:
    """The names of the known sentences of a text, in order; unknown sentences leave no trace but a gap (``_``)."""

    def named(s: Column) -> Column:
        found = None
        for name, pattern in SENTENCES:
            found = F.when(s.rlike(pattern), name) if found is None else found.when(s.rlike(pattern), name)
        return F.when(s.rlike(HINT), found.otherwise("_")).otherwise("_")

    return F.transform(normalised_sentences(text), named)


def _pattern(rule: Rule) -> str:
    between = rf"(?:\w+ ){{0,{rule.gap}}}?"
    return between.join(f"{n} " for n in rule.names)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, sentence_ids, licences, unmatched) for every row of ``docs``.

    sentence_ids are the known sentences in order. licences are those of the rules that match, each once, in the order of
    the rules: a rule takes every place where its identifiers follow each other with at most ``gap`` unknown or other
    sentences between, and what it took is gone for later rules. unmatched are the known sentences that no rule took.
    Null and empty texts have none. Repeated rows and null keys are kept. Only ``key`` and ``text`` are read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.when(t.rlike(HINT), identifiers(t)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(key).alias("_key"), names.alias("_ids"))
    line = F.when(F.size("_ids") > 0, F.concat(F.array_join("_ids", " "), F.lit(" "))).otherwise("")
    rows = rows.withColumn("_left", line).withColumn("_found", F.array().cast("array<string>"))
    for rule in rules:
        pattern = r"(?<!\w)" + _pattern(rule)
        hit = F.col("_left").rlike(pattern)
        rows = rows.withColumns({
            "_found": F.when(hit, F.array_union("_found", F.array(F.lit(rule.licence)))).otherwise(F.col("_found")),
            "_left": F.when(hit, F.regexp_replace("_left", pattern, "_ ")).otherwise(F.col("_left")),
        })
    known = lambda a: F.filter(a, lambda x: (x != "_") & (x != ""))
    return rows.select(F.col("_key").alias(key), known(F.col("_ids")).alias("sentence_ids"), F.col("_found").alias("licences"), known(F.split("_left", " ")).alias("unmatched"))


__all__ = ["RULES", "Rule", "SENTENCES", "identifiers", "normalised_sentences", "scanned"]
