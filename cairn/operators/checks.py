"""Data quality: rules evaluated in one pass, keys, references, sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, failed, checked``: how many rows break each rule, in one scan. A null test counts as broken."""
    sums = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()])
    return sums.select(F.col("_n").alias("checked"), F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failed")) for n in rules])))


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def broken_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that are no ``key``, with their row counts; only distinct values are joined."""
    used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return used.join(target.select(F.col(key).alias("value")), "value", "left_anti")


def sequence_gaps(df: DataFrame, group: str, index: str) -> DataFrame:
    """Per group: its rows, the missing and the repeated index numbers. Indices start at 0."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.max(index).alias("last"), F.array_sort(F.collect_set(index)).alias("seen"))
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), F.transform("seen", lambda x: x.cast("long")))
    return g.select(group, "n", missing.alias("missing"), (F.col("n") - F.size("seen")).alias("repeated"))


def fact_issues(df: DataFrame, facts: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose ``column`` differs from the known ``expected`` of their key, with the fact's severity."""
    return df.join(facts, key).where(~F.col(column).eqNullSafe(F.col("expected"))).select(key, F.col(column).alias("found"), "expected", "severity")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in only one of two tables, and in which."""
    left, right = a.select(*keys, F.lit(True).alias("_a")).distinct(), b.select(*keys, F.lit(True).alias("_b")).distinct()
    both = left.join(right, list(keys), "full")
    return both.where("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))
