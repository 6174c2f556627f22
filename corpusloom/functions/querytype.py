"""Query types: normalising, heuristic detection, validation, evidence shape, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, record, strip

# The known types in their order, and the cue patterns.
QUERY_TYPES = ("single_hop_specific", "single_hop_abstract", "multi_hop_specific", "multi_hop_abstract")
ABSTRACT_PATTERNS = (r"\bwhy\b", r"\bhow\b", r"\bcompare\b", r"\bdifference\b", r"\bsummar", r"\boverview\b", r"\bexplain\b")
MULTI_PATTERNS = (r"\bbetween\b", r"\brelationship\b", r"\bimpact\b", r"\bdepend\b", r"\balso\b")
# The validator looks for these anywhere inside words, unlike the patterns above.
ABSTRACT_CUES = ("why", "how", "explain", "compare", "difference", "summar", "overview")
CLUSTER_PATTERNS = (
    "no relationships match the provided condition. cannot form clusters",
    "no clusters found in the knowledge graph",
    "cannot form clusters",
)
TRANSIENT_PATTERNS = ("connection error", "timed out", "temporarily unavailable", "rate limit")
TRANSIENT_CLASSES = ("apiconnectionerror", "apitimeouterror", "connecterror", "readtimeout", "timeoutexception")


def normalize_type(value: Column) -> Column:
    cleaned = F.replace(F.lower(strip(F.coalesce(value, F.lit("unknown")))), F.lit("-"), F.lit("_"))
    return F.when(cleaned.isin(*QUERY_TYPES), cleaned).otherwise("unknown")


def hop_of(query_type: Column) -> Column:
    return F.when(query_type.startswith("single_hop_"), "single").when(query_type.startswith("multi_hop_"), "multi").otherwise("unknown")


def abstraction_of(query_type: Column) -> Column:
    return F.when(query_type.endswith("_specific"), "specific").when(query_type.endswith("_abstract"), "abstract").otherwise("unknown")


def stated_or(value: Column, derived: Column) -> Column:
    """A stated value wins unless it is blank or ``unknown``."""
    stated = strip(F.coalesce(value, F.lit("")))
    return F.when(stated.isin("", "unknown"), derived).otherwise(stated)


def text_or_list(value: Column) -> Column:
    """Texts of a JSON value that is one text or a list of them: an array, empty for null, "", false, 0 and what is no JSON.

    Numbers and true count as texts, on their own or in a list; nulls in a list are left out; an object stands for its keys in alphabetical order.
    """
    none = F.array().cast("array<string>")

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        listed = F.array_compact(F.try_variant_get(v, "$", "array<string>"))
        empty = (text == "") | (text.isin("0", "false") & (kind != "STRING"))
        return (
            F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
            .when(text.isNotNull() & ~empty, F.array(text)).otherwise(none)
        )

    return F.coalesce(let(F.try_parse_json(value), read), none)


def ordered_unique(values: Column) -> Column:
    """Trimmed, without blanks, first occurrence kept."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: strip(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def _any_match(text: Column, patterns) -> Column:
    return text.rlike("|".join(patterns))


def detect(text: Column, doc_ids: Column, file_ids: Column) -> dict[str, Column]:
    """Heuristic type of a question with its confidence and reasons."""
    lowered = F.lower(strip(F.coalesce(text, F.lit(""))))
    abstract = _any_match(lowered, ABSTRACT_PATTERNS)
    evidence = (F.size(ordered_unique(doc_ids)) >= 2) | (F.size(ordered_unique(file_ids)) >= 2)
    worded = _any_match(lowered, MULTI_PATTERNS)
    multi = evidence | worded
    hop = F.when(multi, "multi").otherwise("single")
    level = F.when(abstract, "abstract").otherwise("specific")
    score = F.lit(0.55) + F.when(evidence, 0.2).otherwise(0.0) + F.when(abstract, 0.15).otherwise(0.0) + F.when(worded, 0.1).otherwise(0.0)
    return {
        "query_type": F.concat(hop, F.lit("_hop_"), level),
        "hop_count": hop,
        "abstraction_level": level,
        "confidence": F.round(F.least(score, F.lit(0.95)), 2),
        "reasons": F.array_compact(
            F.array(
                F.when(abstract, F.lit("abstract_keyword")),
                F.when(evidence, F.lit("multi_evidence")),
                F.when(worded, F.lit("multi_keyword")),
            )
        ),
    }


def evidence_counts(hops: Column, doc_ids: Column, file_ids: Column) -> dict[str, Column]:
    counts = {
        "hop_evidence": F.size(F.coalesce(hops, F.array())),
        "doc_evidence": F.size(F.array_distinct(F.coalesce(doc_ids, F.array()))),
        "file_evidence": F.size(ordered_unique(file_ids)),
    }
    return {**counts, "effective_evidence": F.greatest(*counts.values())}


def issues(query_type: Column, text: Column, evidence: Column, min_hop_evidence: int = 2) -> Column:
    """Array of (severity, code) found in one sample."""
    floor = max(min_hop_evidence, 2)
    kind = strip(F.coalesce(query_type, F.lit("unknown")))
    lowered = F.lower(F.coalesce(text, F.lit("")))
    cue = lowered.rlike("|".join(ABSTRACT_CUES))

    def issue(condition: Column, severity: str, code: str) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    return F.array_compact(
        F.array(
            issue(~kind.isin(*QUERY_TYPES), "error", "unknown_query_type"),
            issue(kind.startswith("multi_hop_") & (evidence < floor), "error", "insufficient_multihop_evidence"),
            issue(kind.startswith("single_hop_") & (evidence >= floor), "error", "singlehop_conflict_evidence"),
            issue(kind.endswith("_abstract") & ~cue, "warn", "abstract_without_cue"),
            issue(kind.endswith("_specific") & cue, "warn", "specific_with_abstract_cue"),
        )
    )


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda i: i["severity"] == "error")


def topology(doc_ids: Column, file_ids: Column) -> Column:
    return (
        F.when(F.size(F.array_distinct(file_ids)) >= 2, "multi_file")
        .when(F.size(F.array_distinct(doc_ids)) >= 2, "multi_doc_same_file")
        .otherwise("single_doc")
    )


def reasoning_hops(query_type: Column, doc_ids: Column, file_ids: Column) -> Column:
    """Up to two hops of a multi-hop sample: one per document, else one per file."""
    none = F.array().cast("array<string>")

    def hop(i: Column, docs: Column, files: Column) -> Column:
        return record(
            hop_id=F.concat(F.lit("hop_"), (i + 1).cast("string")),
            hop_intent=F.lit("evidence_link"),
            reference_doc_ids=docs,
            reference_file_ids=files,
        )

    by_doc = F.transform(F.slice(doc_ids, 1, 2), lambda d, i: hop(i, F.array(d), F.slice(file_ids, 1, 1)))
    by_file = F.transform(F.slice(file_ids, 1, 2), lambda f, i: hop(i, none, F.array(f)))
    chosen = F.when(F.size(doc_ids) > 0, by_doc).when(F.size(file_ids) >= 2, by_file)
    return F.coalesce(F.when(query_type.startswith("multi_hop_"), chosen), F.slice(by_doc, 1, 0))


def error_class(error_class: Column, message: Column) -> dict[str, Column]:
    text = F.lower(strip(F.coalesce(message, F.lit(""))))
    contains = lambda patterns: F.greatest(*[text.contains(p).cast("int") for p in patterns]) == 1
    cluster = contains(CLUSTER_PATTERNS)
    transient = contains(TRANSIENT_PATTERNS) | F.lower(F.coalesce(error_class, F.lit(""))).isin(*TRANSIENT_CLASSES)
    return {
        "retriable": ~cluster,
        "category": F.when(cluster, "cluster_missing").when(transient, "transient_runtime").otherwise("unknown"),
        "reason": F.when(cluster, "knowledge_graph_relationship_or_cluster_unavailable")
        .when(transient, "connection_or_timeout_like_error")
        .otherwise("fallback_to_retry_for_unknown_error"),
    }


def capabilities(answer: Column, contexts: Column, doc_ids: Column, rubric: Column | None = None, tool_calls: Column | None = None) -> Column:
    filled = lambda c: F.size(F.coalesce(c, F.array())) > 0
    flags = [
        F.when(strip(F.coalesce(answer, F.lit(""))) != "", F.lit("has_reference_answer")),
        F.when(filled(contexts), F.lit("has_reference_contexts")),
        F.when(filled(doc_ids), F.lit("has_reference_doc_ids")),
    ]
    if rubric is not None:
        flags.append(F.when(rubric.isNotNull(), F.lit("has_rubric")))
    if tool_calls is not None:
        flags.append(F.when(filled(tool_calls), F.lit("has_reference_tool_calls")))
    return F.array_compact(F.array(*flags))
