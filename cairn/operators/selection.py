"""Exact percentiles without all values in one task: rounds of range counts, then a sort of the few values around each rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a round counts in, and rows of a range up to which its values are sorted.
RANGES, FEW = 256, 5_000


@dataclass
class Sought:
    """A rank of a group (from 0) and the values that it can have: ``low`` to ``high``, ``below`` rows being less than ``low``."""

    group: tuple
    rank: int
    below: int
    rows: int
    low: float
    high: float
    value: float | None = None


def _table(spark, sought: list[Sought], by: list[str], df: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return spark.createDataFrame([(*s.group, i, s.low, s.high) for i, s in enumerate(sought)], f"{fields}{', ' if by else ''}_i int, _low double, _high double")


def _count(df: DataFrame, column: str, by: list[str], sought: list[Sought]) -> None:
    """Narrow each interval to the range that holds its rank, by counts, least and greatest values of the ranges."""
    asked = F.broadcast(_table(df.sparkSession, sought, by, df))  # a row for each sought rank
    v = F.col(column).cast("double")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    met = df.alias("a").join(asked.alias("b"), [*same, (v >= F.col("_low")) & (v <= F.col("_high"))] if by else (v >= F.col("_low")) & (v <= F.col("_high")))
    # The ends are ranges of their own, so that every round narrows, also where an end is infinite.
    endless = (F.col("_low") == float("-inf")) | (F.col("_high") == float("inf"))
    inner = F.when(endless, 0).otherwise(F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES))
    part = F.when(v == F.col("_low"), -1).when(v == F.col("_high"), RANGES).otherwise(inner)
    found = met.groupBy("_i", part.alias("part")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()  # RANGES rows for each rank
    for i, s in enumerate(sought):
        below = s.below
        for r in sorted((r for r in found if r._i == i), key=lambda r: r.low):
            if below + r.n > s.rank:
                s.below, s.rows, s.low, s.high = below, r.n, r.low, r.high
                break
            below += r.n


def _sort(df: DataFrame, column: str, by: list[str], sought: list[Sought]) -> None:
    """Read the ranks from the sorted values of their intervals, FEW rows each at most."""
    asked = F.broadcast(_table(df.sparkSession, sought, by, df))
    v = F.col(column).cast("double")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    inside = (v >= F.col("_low")) & (v <= F.col("_high"))
    rows = df.alias("a").join(asked.alias("b"), [*same, inside] if by else inside).select("_i", v.alias("v")).collect()
    values: dict[int, list[float]] = {}
    for r in rows:
        values.setdefault(r._i, []).append(r.v)
    for i, s in enumerate(sought):
        s.value = sorted(values[i])[s.rank - s.below]


def _between(a: float, b: float, part: float) -> float:
    return a if a == b or not part else a + (b - a) * part


def percentiles(df: DataFrame, column: str, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``*by, percent, value``: exact percentiles with linear interpolation, as ``percentile`` gives them.

    Nulls and NaN are left out; groups without a value give no row. A round is one pass that counts each sought rank's interval
    in RANGES parts; the driver gets that many rows for each rank, and at most FEW values for each in the end. Meant for a number of groups
    that the driver can list. Equal values are one range, so that a frequent value needs no sort.
    """
    by = list(by)
    kept = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    v = F.col(column).cast("double")
    groups = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).where("n > 0").collect()
    sought: dict[tuple, Sought] = {}
    wanted = []
    for g in groups:
        group = tuple(g[c] for c in by)
        for p in percents:
            at = p / 100 * (g.n - 1)
            ranks = int(at), min(int(at) + 1, g.n - 1)
            for r in ranks:
                sought.setdefault((group, r), Sought(group, r, 0, g.n, g.low, g.high))
            wanted.append((group, p, ranks, at - int(at)))
    while many := [s for s in sought.values() if s.low < s.high and s.rows > FEW]:
        _count(kept, column, by, many)
    few = [s for s in sought.values() if s.low < s.high]
    if few:
        _sort(kept, column, by, few)
    found = {k: s.low if s.value is None else s.value for k, s in sought.items()}
    rows = [(*group, float(p), _between(found[group, a], found[group, b], part)) for group, p, (a, b), part in wanted]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return df.sparkSession.createDataFrame(rows, f"{fields}percent double, value double")
