"""Sinks: Parquet layers, documents as JSON, and node and edge tables with idempotent upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_layer(df: DataFrame, path: str, *, row_group_bytes: int = 128 << 20, level: int = 1) -> dict:
    """Write Parquet with zstd and return the counts observed on the way: rows in, rows with a null first column."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"`{df.columns[0]}`").isNull()).alias("null_keys"))
    counted.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.block.size", str(row_group_bytes)).parquet(path)
    return seen.get


def documents(df: DataFrame, key: str, shape: Mapping[str, Column], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``_id`` and the document of each row: the columns of ``shape``, nulls replaced by ``defaults``."""
    cells = [F.coalesce(c, F.lit((defaults or {})[n])).alias(n) if n in (defaults or {}) else c.alias(n) for n, c in shape.items()]
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_id"), F.struct(*cells).alias("doc"))


def write_documents(df: DataFrame, path: str, key: str, shape: Mapping[str, Column], rules: Mapping[str, Column], defaults: Mapping[str, object] | None = None) -> dict[str, int]:
    """Write ``_id, doc`` of the rows that keep all rules under ``path``/part=accepted, and the others under part=rejected; the counts of the pass.

    Rejected rows have ``reasons``, the names of the rules that they break (``key`` where the key is null; a rule that gives null is
    broken), and ``raw``, the row as JSON. ``rows_in`` is always ``rows_out`` + ``rejected``, and each reason is counted; one pass does all.
    """
    broken = F.array_compact(F.array(F.when(F.col(key).isNull(), F.lit("key")), *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    cells = [F.coalesce(c, F.lit((defaults or {})[n])).alias(n) if n in (defaults or {}) else c.alias(n) for n, c in shape.items()]
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    made = df.select(F.col(key).cast("string").alias("_id"), F.struct(*cells).alias("doc"), broken.alias("reasons"), raw.alias("raw")).withColumn("accepted", F.size("reasons") == 0)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows_in"), F.count_if("accepted").alias("rows_out"), F.count_if(~F.col("accepted")).alias("rejected")]
    counts += [F.count_if(F.array_contains("reasons", name)).alias(f"reason_{name}") for name in ("key", *rules)]
    out = made.observe(seen, *counts).select("_id", F.when(F.col("accepted"), F.col("doc")).alias("doc"), "reasons", F.when(~F.col("accepted"), F.col("raw")).alias("raw"), F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("part"))
    out.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(path)
    return seen.get


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], newest: Sequence[Column] = ()) -> DataFrame:
    """Rows of ``current`` that no change replaces, and of each changed key one row: the newest by the order given.

    Without an order the changes must be unique by key.
    """
    fresh = latest(changes, keys, newest) if newest else changes
    return current.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count; each count is pushed into its own scan."""
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out
