"""Work on what is new: unprocessed rows, caches by content hash, dimension keys, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unprocessed(df: DataFrame, done: DataFrame, key: str, order: list[Column], limit: int | None = None) -> DataFrame:
    rest = df.join(done.select(key), key, "left_anti").orderBy(*order)
    return rest if limit is None else rest.limit(limit)


def content_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def split_by_cache(df: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the cached result of their content, and rows that must be computed. ``cache`` is (cache_key, result)."""
    keyed = df.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def with_dimension_keys(dimension: DataFrame, values: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``dimension`` with a row for each new combination of ``columns``; ids are hashes of the values, so reruns agree."""
    fresh = values.select(*columns).distinct().join(dimension.select(*columns), columns, "left_anti")
    return dimension.select(id_col, *columns).unionByName(fresh.withColumn(id_col, F.xxhash64(*columns)).select(id_col, *columns))


def routed(df: DataFrame, in_scope: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows in scope; and the others with the reason. A null test is out of scope."""
    marked = df.withColumn("_in", F.coalesce(in_scope, F.lit(False)))
    return marked.where("_in").drop("_in"), marked.where("NOT _in").drop("_in").withColumn("reason", reason)
