"""Evaluation samples: building, normalising, reviewing, reporting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import querytype as Q
from corpusloom.functions.text import or_missing, squeeze, strip

# Review rules by category and source.
REVIEWED_CATEGORIES = ("regression", "baseline", "specialized", "synthetic")
INSTRUCTIONS = (
    "Check whether the user_input is clear, answerable, and scoped to the selected files.",
    "Check whether reference_answer is correct, concise, and directly answers the question.",
    "If reference_contexts/reference_doc_ids are present, verify they really support the answer.",
    "Mark review_status as approved, rejected, or needs_revision before using the dataset in evaluation.",
)
SOURCE_INSTRUCTIONS = {
    "synthetic": (
        "Synthetic samples must be reviewed before they are promoted into baseline or regression usage.",
        "Reject samples that look templated, ambiguous, trivially answerable, or distributionally unrealistic.",
    )
}
CATEGORY_INSTRUCTIONS = {
    "regression": (
        "Regression samples should represent real failures or critical business paths.",
        "Do not include speculative or weakly grounded samples in the regression set.",
    ),
    "baseline": ("Baseline samples should be representative of normal usage, not only edge cases.",),
    "exploration": ("Exploration samples can keep harder or more speculative cases, but still require factual sanity checks.",),
}
REVIEW_SHEET = (
    "sample_id", "review_status", "review_notes", "difficulty_level", "scenario_type", "user_input", "reference_answer",
    "scope_file_ids", "reference_doc_ids", "tags",
)


def normalize(samples: DataFrame) -> DataFrame:
    """Blank-free ordered lists, known query type, derived hop and abstraction where none is stated, capabilities."""
    contexts = F.filter(F.transform("reference_contexts", lambda x: strip(x)), lambda x: x != "")
    rows = samples.withColumns(
        {
            "reference_contexts": F.coalesce(contexts, F.array().cast("array<string>")),
            **{c: Q.ordered_unique(F.col(c)) for c in ("reference_doc_ids", "scope_file_ids", "tags")},
            "query_type": Q.normalize_type(F.col("query_type")),
        }
    )
    unknown = F.lit("unknown")
    rows = rows.withColumns(
        {
            "hop_count": Q.stated_or(F.col("hop_count"), Q.hop_of(F.col("query_type"))),
            "abstraction_level": Q.stated_or(F.col("abstraction_level"), Q.abstraction_of(F.col("query_type"))),
            "evidence_topology": Q.stated_or(F.col("evidence_topology"), unknown),
            "query_type_source": Q.stated_or(F.col("query_type_source"), unknown),
        }
    )
    found = Q.capabilities(F.col("reference_answer"), F.col("reference_contexts"), F.col("reference_doc_ids"))
    given = F.coalesce(F.col("capabilities"), F.array().cast("array<string>"))
    return rows.withColumn("capabilities", F.array_sort(F.array_distinct(F.concat(given, found))))


def first_filled(*names: str) -> Column:
    """First column that is neither null nor an empty string."""
    return F.coalesce(*[or_missing(F.col(n)) for n in names])


def reviewed(samples: DataFrame, statuses: Sequence[str], limit: int | None = None, key: str = "sample_id") -> DataFrame:
    """Samples with one of the review statuses (written in any case, with blanks around), if asked only the first ``limit`` by key.

    The limit is a sorted top-k: each task keeps at most ``limit`` rows before they meet.
    """
    wanted = [s.strip().lower() for s in statuses if s.strip()]
    rows = samples.where(F.lower(strip("review_status")).isin(*wanted))
    return rows if limit is None else rows.orderBy(key).limit(limit)


def usable_rows(rows: DataFrame) -> DataFrame:
    """Generated rows with a question and at least one non-blank context, under one name each."""
    question = first_filled("user_input", "question", "query")
    contexts = F.filter("contexts", lambda c: strip(c) != "")
    return rows.withColumns({"user_input": question, "contexts": contexts}).where(question.isNotNull() & (F.size("contexts") > 0))


def map_contexts(rows: DataFrame, chunks: DataFrame, key: str, fallback: str = "fallback_ids") -> DataFrame:
    """Chunk and file ids of each row's contexts by equal normalised text; rows without a match keep the fallback ids.

    Only chunks of the row's own scope count, so a passage copied all over the corpus finds its few copies there.
    Texts are joined by their hash, so neither side shuffles a text.
    """
    digest = lambda c: F.sha2(squeeze(c), 256)
    contexts = rows.select(key, "scope_file_ids", F.posexplode("contexts").alias("pos", "context"))
    contexts = contexts.select(key, "pos", digest(F.col("context")).alias("digest"), F.explode("scope_file_ids").alias("file_id"))
    known = chunks.select(digest(F.col("text")).alias("digest"), "parent_id", F.col("file_id").cast("string").alias("file_id"))
    matches = contexts.join(known, ["file_id", "digest"]).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("pos", "parent_id", "file_id"))).alias("_m"))
    joined = rows.join(matches, key, "left")
    ids = F.array_distinct(F.transform("_m", lambda m: m["parent_id"]))
    files = F.array_distinct(F.transform("_m", lambda m: m["file_id"]))
    return joined.withColumns(
        {
            "reference_doc_ids": F.when(F.size(F.coalesce(ids, F.array())) > 0, ids).otherwise(F.col(fallback)),
            "reference_file_ids": F.coalesce(files, F.array().cast("array<string>")),
        }
    ).drop("_m")


def infer_scope(samples: DataFrame, parents: DataFrame, key: str = "sample_id") -> DataFrame:
    """Fill an empty scope with the files of the sample's reference documents, in reference order."""
    refs = samples.where(F.size("scope_file_ids") == 0).select(key, F.posexplode("reference_doc_ids").alias("pos", "parent_id"))
    found = refs.join(parents.select("parent_id", "file_id"), "parent_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "file_id")))
    files = F.array_distinct(F.transform(ordered, lambda s: s["file_id"].cast("string")))
    inferred = found.groupBy(key).agg(files.alias("_files"))
    joined = samples.join(inferred, key, "left")
    return joined.withColumns(
        {"scope_file_ids": F.coalesce("_files", "scope_file_ids"), "scope_inferred": F.col("_files").isNotNull()}
    ).drop("_files")


def validate(samples: DataFrame, mode: str = "warn", min_hop_evidence: int = 2) -> DataFrame:
    """Add ``issues`` and ``valid``; ``strict`` drops invalid samples, ``off`` checks nothing."""
    if mode not in ("off", "warn", "strict"):
        raise ValueError(f"unknown validator mode: {mode}")
    evidence = Q.evidence_counts(F.col("reasoning_hops"), F.col("reference_doc_ids"), F.col("reference_file_ids"))
    found = Q.issues(F.col("query_type"), F.col("user_input"), evidence["effective_evidence"], min_hop_evidence)
    rows = samples.withColumn("issues", F.slice(found, 1, 0) if mode == "off" else found)
    rows = rows.withColumn("valid", Q.is_valid(F.col("issues")))
    return rows.where("valid") if mode == "strict" else rows


def validation_counts(samples: DataFrame, mode: str = "warn", min_hop_evidence: int = 2) -> tuple[DataFrame, DataFrame]:
    """(one summary row, one row per issue code)."""
    checked = validate(samples, "off" if mode == "off" else "warn", min_hop_evidence)
    severity = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s)))
    dropped = F.count_if(~F.col("valid")) if mode == "strict" else F.lit(0).cast("long")
    summary = checked.agg(
        F.count("*").alias("input_count"), (F.count("*") - dropped).alias("output_count"), dropped.alias("dropped_count"),
        severity("error").alias("error_count"), severity("warn").alias("warning_count"),
    )
    codes = checked.select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))
    return summary, codes


def apply_review(samples: DataFrame, review: DataFrame, keep_rejected: bool = False) -> DataFrame:
    """Reviewed cells replace the sample's; blank cells and unknown ids change nothing; rejected samples leave."""
    cells = ("review_status", "review_notes", "difficulty_level", "scenario_type")
    new = review.select(strip("sample_id").alias("sample_id"), *[strip(c).alias(f"_{c}") for c in cells])
    joined = samples.join(new, "sample_id", "left")
    rows = joined.withColumns({c: F.coalesce(or_missing(F.col(f"_{c}")), F.col(c)) for c in cells}).drop(*[f"_{c}" for c in cells])
    return rows if keep_rejected else rows.where(F.col("review_status") != "rejected")


def review_sheet(samples: DataFrame) -> DataFrame:
    """Flat sheet for reviewers; lists are joined by ``|``."""
    arrays = ("scope_file_ids", "reference_doc_ids", "tags")
    cols = [
        F.array_join(c, "|").alias(c) if c in arrays else F.coalesce(F.col(c), F.lit("")).alias(c) if c == "reference_answer" else F.col(c)
        for c in REVIEW_SHEET
    ]
    return samples.select(*cols)


def instructions(category: str, source_type: str) -> list[str]:
    return [*INSTRUCTIONS, *SOURCE_INSTRUCTIONS.get(source_type, ()), *CATEGORY_INSTRUCTIONS.get(category, ())]


def review_required(category: Column) -> Column:
    return category.isin(*REVIEWED_CATEGORIES)


def shared_capabilities(samples: DataFrame) -> DataFrame:
    """Capabilities every sample has. Counts are combined map-side; at most a handful of rows are shuffled."""
    n = samples.agg(F.count("*").alias("n")).scalar()
    caps = samples.select(F.explode(F.array_distinct("capabilities")).alias("capability"))
    return caps.groupBy("capability").agg(F.count("*").alias("samples")).where(F.col("samples") == n).select("capability")


def any_capabilities(records: DataFrame) -> DataFrame:
    return records.select(F.explode("capabilities").alias("capability")).distinct()


def manifest(samples: DataFrame, *, name: str, version: str, category: str, source_type: str, description: str = "", metadata: Mapping[str, str] | None = None) -> DataFrame:
    """One row describing a dataset."""
    shared = shared_capabilities(samples).agg(F.array_sort(F.collect_set("capability")).alias("c")).scalar()
    extra = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return samples.agg(F.count("*").alias("sample_count")).select(
        F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(category).alias("category"), F.lit(source_type).alias("source_type"),
        F.lit(description).alias("description"), shared.alias("capabilities"), review_required(F.lit(category)).alias("review_required"),
        F.array(*[F.lit(x) for x in instructions(category, source_type)]).alias("review_instructions"), "sample_count", extra.alias("metadata"),
    )


REPORT_DIMENSIONS = ("review_status", "source_type", "scenario_type", "difficulty_level")


def dimension_counts(samples: DataFrame, dimensions: Sequence[str] = REPORT_DIMENSIONS) -> DataFrame:
    """(dimension, value, n): each dimension counted on its own in one pass."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = samples.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    names = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(dimensions) - 1 - i)) == 0, F.lit(d)) for i, d in enumerate(dimensions)])
    return grouped.select(names.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n")


def coverage_flags(samples: DataFrame) -> DataFrame:
    """One row: how many samples have what, and how large a share that is."""
    has = {
        "with_reference_answer": strip(F.coalesce("reference_answer", F.lit(""))) != "",
        "with_reference_contexts": F.size("reference_contexts") > 0,
        "with_reference_doc_ids": F.size("reference_doc_ids") > 0,
        "with_scope_file_ids": F.size("scope_file_ids") > 0,
    }
    n = F.greatest(F.count("*"), F.lit(1))
    counts = {name: F.count_if(c) for name, c in has.items()}
    return samples.agg(
        F.count("*").alias("sample_count"), *[c.alias(k) for k, c in counts.items()], *[F.round(c / n, 6).alias(f"{k}_ratio") for k, c in counts.items()]
    )


def unique_ids(samples: DataFrame, column: str) -> DataFrame:
    return samples.select(F.explode(column).alias("id")).agg(F.countDistinct("id").alias("n"))


def covered_files(samples: DataFrame) -> Column:
    """Files a sample speaks about: stated references, else its source file, else a scope of one file."""
    stated = Q.ordered_unique(F.col("reference_file_ids"))
    source = Q.ordered_unique(F.array("source_file_id"))
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.when(F.size(stated) > 0, stated)
        .when(F.size(source) > 0, source)
        .when(F.size("scope_file_ids") == 1, F.col("scope_file_ids"))
        .otherwise(none)
    )


def file_coverage(samples: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` files most samples speak about; ties go to the smaller id."""
    files = samples.select(F.explode(covered_files(samples)).alias("file_id"))
    return files.groupBy("file_id").agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "file_id").limit(n)


def realized_distribution(samples: DataFrame) -> DataFrame:
    """Count and share of every known query type, zeros included."""
    one = lambda name: F.count_if(F.col("query_type") == name)
    total = F.count("*")
    cells = F.array(*[F.struct(F.lit(n).alias("query_type"), one(n).alias("n"), F.round(F.when(total > 0, one(n) / total).otherwise(0.0), 6).alias("share")) for n in Q.QUERY_TYPES])
    return samples.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def core_idea_question(sentence: Column) -> Column:
    """Adapter from a statement to an abstract single-hop question."""
    return F.concat(F.lit("Explain the core idea behind: "), F.rtrim(sentence))
