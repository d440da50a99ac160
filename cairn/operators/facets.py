"""Bucket and metric aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = {
    "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "value_count": F.count, "cardinality": F.countDistinct,
    "variance": F.var_pop, "std_deviation": F.stddev_pop, "median": F.median,
}


def metrics(spec: Mapping[str, tuple[str, str]]) -> list[Column]:
    """``{"avg_price": ("avg", "price")}`` as aggregate columns."""
    return [METRICS[kind](column).alias(name) for name, (kind, column) in spec.items()]


def terms(df: DataFrame, key: str | Sequence[str], spec: Mapping[str, tuple[str, str]], size: int = 10) -> DataFrame:
    """The largest buckets of a key with metrics; ties go by key."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("doc_count"), *metrics(spec)).orderBy(F.desc("doc_count"), *keys).limit(size)


def nested_terms(df: DataFrame, key: str, inner: str, size: int = 10) -> DataFrame:
    """Per bucket of ``key`` its largest ``size`` buckets of ``inner``, as rows ranked inside the bucket."""
    counts = df.groupBy(key, inner).agg(F.count("*").alias("doc_count"))
    best = Window.partitionBy(key).orderBy(F.desc("doc_count"), inner)
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def bucket_of(value: Column, interval: float) -> Column:
    return F.floor(value / F.lit(float(interval))).cast("double") * F.lit(float(interval))


def histogram(df: DataFrame, column: str, interval: float, spec: Mapping[str, tuple[str, str]] | None = None, min_doc_count: int = 1, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Fixed-width buckets. With ``min_doc_count`` 0, ``bounds`` says which empty buckets to give."""
    found = df.where(F.col(column).isNotNull()).groupBy(bucket_of(F.col(column), interval).alias("bucket")).agg(F.count("*").alias("doc_count"), *metrics(spec or {}))
    if min_doc_count == 0 and bounds:
        first, last = int(bounds[0] // interval), int(bounds[1] // interval)
        grid = df.sparkSession.range(first, last + 1).select((F.col("id") * F.lit(float(interval))).alias("bucket"))
        return grid.join(found, "bucket", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return found.where(F.col("doc_count") >= min_doc_count)


def ladder(value: Column, cuts: Sequence[float], names: Sequence[str], closed_right: bool = False, null: str | None = None) -> Column:
    """The band of a value: ``names`` has one more entry than ``cuts``. Null falls to ``null``, by default the last band."""
    out = F.when(value.isNull(), F.lit(null)) if null is not None else F
    for cut, name in zip(cuts, names[:-1], strict=True):
        out = out.when(value <= cut if closed_right else value < cut, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def ranges(df: DataFrame, column: str, cuts: Sequence[float], names: Sequence[str], spec: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(ladder(F.col(column), cuts, names).alias("bucket")).agg(F.count("*").alias("doc_count"), *metrics(spec or {}))


def extended_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.sum(c).alias("total"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("variance"), (F.max(c) - F.min(c)).alias("range"))


def with_means(df: DataFrame, by: str, means: dict[str, str]) -> DataFrame:
    """``df`` with the mean of columns over the rows with its ``by``, as new name -> column; null where ``by`` is null.

    Grouped and joined, so that a large group is averaged in parts and no task holds it, as a window would.
    """
    return df.join(df.groupBy(by).agg(*[F.avg(c).alias(name) for name, c in means.items()]), by, "left")


def percentiles(df: DataFrame, column: str, percents: Sequence[float], exact: bool = True) -> DataFrame:
    """One row per percent. ``exact`` sorts all values; the approximation is mergeable and bounded in memory."""
    marks = F.array(*[F.lit(p / 100) for p in percents])
    value = F.percentile(column, marks) if exact else F.percentile_approx(column, marks, F.lit(10_000))
    return df.agg(value.alias("v")).select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*[F.lit(float(p)) for p in percents]), F.col("i")).alias("percent"), "value")


def aggregate(df: DataFrame, spec: Mapping) -> DataFrame:
    """One aggregation from a specification: terms, histogram, date_histogram, range, stats, extended_stats or a metric, with ``aggs``."""
    inner = spec.get("aggs", {})
    kind = next(k for k in spec if k != "aggs")
    body = spec[kind]
    if kind == "terms":
        return terms(df, body["field"], inner, body.get("size", 10))
    if kind == "histogram":
        return histogram(df, body["field"], body["interval"], inner, body.get("min_doc_count", 1))
    if kind == "date_histogram":
        return df.groupBy(F.date_trunc(body["calendar_interval"], body["field"]).alias("bucket")).agg(F.count("*").alias("doc_count"), *metrics(inner))
    if kind == "range":
        return ranges(df, body["field"], body["cuts"], body["names"], inner)
    if kind in ("stats", "extended_stats"):
        out = extended_stats(df, body["field"])
        return out if kind == "extended_stats" else out.select("n", "least", "most", "mean", "total")
    return df.agg(*metrics({kind: (kind, body["field"])}))


def with_total(df: DataFrame, key: str, aggs: Sequence[Column]) -> DataFrame:
    """Grouped rows and one row over everything, in one pass; ``is_total`` tells them apart."""
    return df.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *aggs)
