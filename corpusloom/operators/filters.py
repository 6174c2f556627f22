"""Metadata filters, retrieval scopes and model slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

from corpusloom.operators.running import ranked_rows

# Range operators of a filter, and the keys that are search settings rather than filters.
RANGES = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
IGNORED_KEYS = ("k",)


def metadata_filter(conditions: Mapping[str, Any], resolve: Callable[[str], Column] = F.col) -> Column:
    """One predicate from a filter: a list means any of, a mapping a range or existence, anything else equality.

    Plain column comparisons, so that the predicate reaches the scan.
    """
    predicate = F.lit(True)
    for name, wanted in conditions.items():
        if name in IGNORED_KEYS:
            continue
        column = resolve(name)
        if isinstance(wanted, Mapping):
            for operator, bound in wanted.items():
                if operator == "exists":
                    predicate = predicate & (column.isNotNull() if bound else column.isNull())
                elif operator in RANGES:
                    predicate = predicate & RANGES[operator](column, F.lit(bound))
                else:
                    raise ValueError(f"unknown filter operator: {operator}")
        elif isinstance(wanted, (list, tuple, set)):
            predicate = predicate & column.isin(*wanted)
        else:
            predicate = predicate & (column == F.lit(wanted))
    return predicate


def in_scope(rows: DataFrame, scopes: DataFrame, scope_id: str) -> DataFrame:
    """Rows of the files of one scope."""
    files = scopes.where(F.col("scope_id") == scope_id).select("file_id")
    return rows.join(files, "file_id", "left_semi")


def set_scope(scopes: DataFrame, scope_id: str, files: DataFrame) -> DataFrame:
    """Replace a scope's files."""
    return clear_scope(scopes, scope_id).unionByName(files.select(F.lit(scope_id).alias("scope_id"), "file_id").distinct())


def clear_scope(scopes: DataFrame, scope_id: str) -> DataFrame:
    return scopes.where(F.col("scope_id") != scope_id)


def check_queries(queries: DataFrame, scopes: DataFrame) -> DataFrame:
    """Add ``reject_reason``: empty query, or a scope without files (null = fine)."""
    known = scopes.select("scope_id").distinct().withColumn("_known", F.lit(True))
    rows = queries.join(known, "scope_id", "left")
    empty = strip(F.coalesce("text", F.lit(""))) == ""
    reason = F.when(empty, "empty_query").when(F.col("_known").isNull(), "empty_scope")
    return rows.withColumn("reject_reason", reason).drop("_known")


def scalar_metadata(metadata: Column) -> Column:
    """Drop nested values of a map<string,string> of JSON values."""
    return F.map_filter(metadata, lambda _, v: ~F.coalesce(v, F.lit("")).rlike(r"^\s*[\[{]"))


# --- slots for models ----------------------------------------------------------------------------------------


def generate(batches: DataFrame, generator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Slot for a question generator: a function over Arrow batches that loads its model once per task."""
    return batches.mapInPandas(generator, schema)


def stamped(rows: DataFrame, keys: list[str], order: str, requested: str, query_type: Column, source: str) -> DataFrame:
    """Generated rows with their type, cut to the number requested. A row that names its own source keeps it."""
    kept = ranked_rows(rows, keys, [F.asc(order)], None, "generated_no").where(F.col("generated_no") <= F.col(requested))
    own = [F.nullif(F.col("query_type_source"), F.lit(""))] if "query_type_source" in rows.columns else []
    return kept.withColumns({"query_type": query_type, "query_type_source": F.coalesce(*own, F.lit(source))})


def reference_answers(samples: DataFrame, answer: Column) -> DataFrame:
    """A newly generated answer replaces the one from history unless it is blank; the source is recorded."""
    fresh = F.nullif(strip(answer), F.lit(""))
    return samples.withColumns(
        {
            "reference_answer_source": F.when(fresh.isNotNull(), "ai").otherwise("history"),
            "reference_answer": F.coalesce(fresh, F.col("reference_answer")),
        }
    )


def online_record(rows: DataFrame, detected: Mapping[str, Column]) -> DataFrame:
    """Counts and detected type of an online request."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return rows.withColumns(
        {
            **detected,
            "query_type_source": F.lit("online_heuristic"),
            "retrieved_doc_count": size("actual_doc_ids"),
            "retrieved_file_count": size("actual_file_ids"),
            "retrieved_context_count": size("actual_contexts"),
        }
    )
