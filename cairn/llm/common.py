"""What the operators of this package share: the word pattern, shared folders, small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. Java and RE2 read this pattern alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a local session, as in tests, gets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not when the driver next happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(rows: DataFrame, hash_col: str, most: int, by: str | None = None, least: int = 1) -> list:
    """At most ``most`` rows, those with the least 64-bit hash, brought to the driver; shared by the values of ``by`` if named, ``least`` each.

    Counting first lets the tasks send little more than the sample: only hashes below the share that is wanted.
    """
    groups = rows.groupBy(by).count().collect() if by else [(None, rows.count())]
    each = max(least, most // max(1, len(groups)))
    share = lambda n: min(1.0, (1.2 * each + 100) / max(n, 1))
    cut, last = F.lit(None).cast("long"), -(2**63)
    for value, n in groups:
        top = min(2**63 - 1, int(-(2**63) + share(n) * 2**64))
        last = max(last, top)
        cut = F.when(F.col(by) == value, F.lit(top)).otherwise(cut) if by else F.lit(top)
    drawn = {}
    few = rows.where(F.col(hash_col) <= F.lit(last))  # a bound that does not depend on the group reaches below joins
    for row in sorted(few.where(F.col(hash_col) <= cut).collect(), key=lambda r: (r[hash_col], str(r))):
        drawn.setdefault(row[by] if by else 0, []).append(row)
    return [row for group in drawn.values() for row in group[:each]]
