"""Run scoring: metric tables, judge-based measures with stand-ins, run summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.metrics import K_VALUES, all_metrics
from corpusloom.functions.text import let, or_missing, sentences, terms

# Judge metrics in order, and the capabilities of which one is needed (none = always).
JUDGE_METRICS = (
    ("faithfulness", ()),
    ("answer_relevancy", ()),
    ("context_precision", ()),
    ("context_recall", ("has_reference_answer",)),
    ("context_entities_recall", ("has_reference_contexts", "has_reference_answer")),
)
SUPPORT_THRESHOLD = 0.5


def successful(records: DataFrame) -> DataFrame:
    """Only finished records with an answer are scored."""
    return records.where((F.col("status") == "success") & or_missing(F.col("actual_response")).isNotNull())


def retrieval_scores(records: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Every retrieval metric at every depth, one row per sample."""
    return records.withColumns(all_metrics(F.col("actual_doc_ids"), F.col("reference_doc_ids"), k_values))


def join_scores(records: DataFrame, *parts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Score tables side by side; a sample missing from one has nulls there."""
    out = records
    for part in parts:
        out = out.join(part, key, "left")
    return out


def long_scores(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys…, metric, value); NaN counts as no score."""
    rows = scores.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    rows = rows.unpivot(list(keys), list(metrics), "metric", "value")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def metric_means(long: DataFrame, group: str = "query_type") -> DataFrame:
    """Means by (group, metric) and by metric alone in one pass; the group is null in the overall rows."""
    named = long.withColumn(group, F.coalesce(or_missing(F.col(group)), F.lit("unknown")))
    sets = [[F.col(group), F.col("metric")], [F.col("metric")]]
    return named.groupingSets(sets, F.col(group), F.col("metric")).agg(
        F.round(F.avg("value"), 6).alias("metric_mean"), F.count("value").alias("scored"), F.count("*").alias("samples")
    )


def pass_rate(verdicts: DataFrame, passed: str = "passed") -> DataFrame:
    """Share of passed among judged rows; rows without a verdict do not count."""
    return verdicts.agg(F.count(passed).alias("judged"), F.round(F.avg(F.when(F.col(passed), 1.0).when(~F.col(passed), 0.0)), 6).alias("correctness_pass_rate"))


def judgeable(reference: Column, answer: Column) -> Column:
    return or_missing(reference).isNotNull() & or_missing(answer).isNotNull()


def run_summary(records: DataFrame) -> DataFrame:
    """One row of totals. The failed ids are a table of their own, see ``failed_samples``."""
    ok = F.col("status") == "success"
    return records.agg(
        F.count("*").alias("total_sample_count"),
        F.count_if(ok & or_missing(F.col("actual_response")).isNotNull()).alias("scored_sample_count"),
        F.count_if(~ok).alias("failed_sample_count"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )


def failed_samples(records: DataFrame, n: int | None = None) -> DataFrame:
    """Failed records by id, the first ``n`` for a report."""
    failed = records.where(F.col("status") != "success").select("sample_id", "error_message").orderBy("sample_id")
    return failed if n is None else failed.limit(n)


def select_metrics(capabilities: Column) -> dict[str, Column]:
    """Judge metrics a capability set allows, and those it rules out."""
    allowed, ruled_out = [], []
    for name, needs in JUDGE_METRICS:
        ok = F.arrays_overlap(capabilities, F.array(*[F.lit(n) for n in needs])) if needs else F.lit(True)
        allowed.append(F.when(ok, F.lit(name)))
        ruled_out.append(F.when(~ok, F.lit(name)))
    return {"metrics": F.array_compact(F.array(*allowed)), "skipped": F.array_compact(F.array(*ruled_out))}


# --- judge-based measures ------------------------------------------------------------------------------------
#
# A judge is any column function (claim, evidence) -> boolean. The built-in stand-in is token overlap, not a model.

Judge = Callable[[Column, Column], Column]


def overlap_judge(threshold: float = SUPPORT_THRESHOLD) -> Judge:
    """A claim is supported if enough of its distinct terms occur in the evidence terms."""

    def judge(claim: Column, evidence_terms: Column) -> Column:
        wanted = F.array_distinct(terms(claim))
        return let(wanted, lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, evidence_terms)) / F.size(w) >= threshold).otherwise(False))

    return judge


def _share(values: Column) -> Column:
    """Share of true values; null for none."""
    return let(values, lambda v: F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: x)) / F.size(v)))


def supported_share(text: Column, contexts: Column, judge: Judge | None = None) -> Column:
    """Faithfulness of an answer, or recall of a reference answer: supported claims over all claims."""
    judge = judge or overlap_judge()
    evidence = F.array_distinct(terms(F.array_join(contexts, " ")))
    return let(evidence, lambda e: _share(F.transform(sentences(text), lambda s: judge(s, e))))


def context_precision(question: Column, contexts: Column, threshold: float = 0.2) -> Column:
    """Mean precision at the ranks of useful contexts; 0 where none is useful."""
    judge = overlap_judge(threshold)
    useful = F.transform(contexts, lambda c: judge(question, F.array_distinct(terms(c))))

    def at_ranks(v: Column) -> Column:
        precision = F.transform(v, lambda x, i: F.when(x, F.size(F.filter(F.slice(v, 1, i + 1), lambda y: y)) / (i + 1)).otherwise(0.0))
        hits = F.size(F.filter(v, lambda x: x))
        return F.when(F.size(v) > 0, F.when(hits > 0, F.aggregate(precision, F.lit(0.0), lambda a, p: a + p) / hits).otherwise(0.0))

    return let(useful, at_ranks)


def entities(text: Column) -> Column:
    """Stand-in for entity extraction: distinct capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+)"), 1))


def entity_recall(reference: Column, contexts: Column) -> Column:
    wanted = entities(reference)
    found = entities(F.array_join(contexts, " "))
    return let(wanted, lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, found)) / F.size(w)))


def isolate_failures(values: Column, errors: Column) -> dict[str, Column]:
    """Metric results of a request: good values, failures, and success if at least one metric came back."""
    good = F.map_filter(values, lambda _, v: v.isNotNull() & ~F.isnan(v))
    failed = F.map_filter(errors, lambda _, e: e.isNotNull())
    any_good = F.size(good) > 0
    return {
        "metrics": good,
        "metric_failures": failed,
        "status": F.when(any_good, "success").otherwise("failed"),
        "error_message": F.when(~any_good, "No online metric completed successfully."),
    }


def judge_input(record_columns: Sequence[str]) -> dict[str, Column]:
    """A record as judge input; reference fields are null when absent."""
    out = {"user_input": F.col("user_input"), "response": F.col("actual_response"), "retrieved_contexts": F.col("actual_contexts")}
    if "reference_answer" in record_columns:
        out["reference"] = or_missing(F.col("reference_answer"))
    if "reference_contexts" in record_columns:
        out["reference_contexts"] = F.when(F.size("reference_contexts") > 0, F.col("reference_contexts"))
    if "reference_context_ids" in record_columns:
        has = F.size("reference_context_ids") > 0
        out["reference_context_ids"] = F.when(has, F.col("reference_context_ids"))
        out["retrieved_context_ids"] = F.when(has, F.col("actual_doc_ids"))
    return out


def run_records(samples: DataFrame, ranked: DataFrame, key: str = "sample_id", id_col: str = "doc_id", also: Mapping[str, str] | None = None) -> DataFrame:
    """Samples with the ids a run retrieved, in rank order. A sample's list is as short as the search depth.

    ``also`` maps further columns of the record to columns of ``ranked``: ids (names that end in ``_ids``) are listed once
    each, at their first rank, all else as often as it was found. ``status`` tells whether anything was found.
    """
    names = {"actual_doc_ids": id_col, **(also or {})}
    got = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *dict.fromkeys(names.values())))).alias("_got"))
    found = F.coalesce("_got", F.array())
    out = samples.join(got, key, "left")
    for name, column in names.items():
        values = F.transform(found, lambda s: s[column])
        out = out.withColumn(name, F.array_distinct(values) if name.endswith("_ids") else values)
    if also is not None:
        out = out.withColumn("status", F.when(F.col("_got").isNull(), "empty").otherwise("success"))
    return out.drop("_got")
