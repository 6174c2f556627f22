"""File registry rows, loader choice, and keyed deletes across linked tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.languages import SUPPORTED_EXTENSIONS
from corpusloom.functions.text import base_name, directory, strip, suffix


def registry_rows(paths: DataFrame, path: str = "path") -> DataFrame:
    """Directory, name and extension of each path, and why a path is refused (null = accepted)."""
    extension = suffix(F.col(path))
    reason = F.when(F.col(path).isNull() | (strip(path) == ""), "missing_path").when(
        ~extension.isin(*SUPPORTED_EXTENSIONS), F.concat(F.lit("unsupported_type:"), extension)
    )
    return paths.withColumns(
        {
            "file_directory": directory(F.col(path)),
            "file_name": base_name(F.col(path)),
            "file_extension": extension,
            "reject_reason": reason,
        }
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNotNull())


def first_loader(loaders: Mapping[str, Column]) -> dict[str, Column]:
    """Text of the first loader that yields one, in the given order, and that loader's name."""
    text = F.coalesce(*loaders.values())
    name = F.coalesce(*[F.when(col.isNotNull(), F.lit(n)) for n, col in loaders.items()])
    return {"text": text, "document_loader": name}


def delete_cascade(tables: Mapping[str, DataFrame], doomed: DataFrame, keys: Mapping[str, str]) -> dict[str, DataFrame]:
    """Drop every row of every table whose key is in ``doomed`` (one column ``key``)."""
    gone = doomed.select(F.col(doomed.columns[0]).alias("_gone")).distinct()
    return {
        name: table.join(gone, table[keys[name]] == gone["_gone"], "left_anti") for name, table in tables.items()
    }


def get_many(requests: DataFrame, table: DataFrame, ids: str, key: str) -> DataFrame:
    """Rows of ``table`` for each request's id list, in the list's order; unknown ids drop out."""
    others = [c for c in requests.columns if c != ids]
    wanted = requests.select(*others, F.posexplode(ids).alias("pos", key))
    return wanted.join(table, key)


def point_lookup(requests: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found rows, requested keys without a row)."""
    keys = table.select(key)
    return requests.join(table, key), requests.join(keys, key, "left_anti")


def children_of(parents: DataFrame, children: DataFrame, key: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(children of the wanted parents, wanted parents that have none)."""
    wanted = parents.select(key).distinct()
    return children.join(wanted, key, "left_semi"), wanted.join(children.select(key), key, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key. The maximum is taken map-side first, so a key written a million times costs one row."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
