"""A table of newest rows by key that a batch changes in part: rows lie in buckets by key, and only buckets with changed keys are written.

Every bucket has two slots. A merge writes a changed bucket's new rows to the slot that is not in use and then a manifest that
says which slot of each bucket counts; so a reader sees the table before or after a merge, a merge that runs again does the same
again, and what a merge replaces is overwritten by the next one. Manifests alternate between two folders in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cairn.sources.sinks import latest


def manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, int], int, int]:
    """The slot in use of each bucket, the number of the merge that said so, and the folder of that manifest; -1 where there is none."""
    try:
        said = spark.read.schema("bucket int, slot int, number long, turn int").parquet(f"{path}/manifest")
        rows = said.where(F.col("number") < before).collect() if before is not None else said.collect()  # a row for each bucket, twice
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    last = max((r.number for r in rows), default=-1)
    used = [r for r in rows if r.number == last]
    return {r.bucket: r.slot for r in used}, last, used[0].turn if used else -1


def _read(spark: SparkSession, path: str, schema: StructType, slots: dict[int, int]) -> DataFrame:
    stored = StructType([*schema.fields]).add("slot", IntegerType()).add("bucket", IntegerType())
    use = F.lit(False)
    for slot in (0, 1):
        use = use | ((F.col("slot") == slot) & F.col("bucket").isin([b for b, s in slots.items() if s == slot]))
    return spark.read.schema(stored).parquet(f"{path}/data").where(use).drop("slot", "bucket")


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows after the last merge."""
    slots, _, _ = manifest(spark, path)
    return _read(spark, path, schema, slots) if slots else spark.createDataFrame([], schema)


def merge(batch: DataFrame, number: int, path: str, keys: Sequence[str], newest: Sequence[Column], buckets: int = 64) -> list[int]:
    """Keep of each key the first row in the order ``newest`` of the table and the batch; the buckets that were written.

    ``number`` grows from merge to merge; a merge of the same number replaces its own result. Null keys are keys. ``buckets`` stays the same for a
    table. A crowded bucket is written by as many tasks as its rows make shuffle partitions, since rows are dealt by key.
    """
    spark = batch.sparkSession
    slots, _, turn = manifest(spark, path, number)
    home = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    changed = sorted(r.bucket for r in batch.select(home.alias("bucket")).distinct().collect())  # ``buckets`` rows at most
    if not changed:
        return []
    rows = batch
    if old := {b: slots[b] for b in changed if b in slots}:
        rows = _read(spark, path, batch.schema, old).unionByName(batch)
    to = {b: 1 - slots.get(b, 1) for b in changed}
    slot = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    kept = latest(rows, keys, newest).withColumn("bucket", home).withColumn("slot", slot[F.col("bucket")])
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").option("compression", "zstd").parquet(f"{path}/data")
    said = spark.createDataFrame([(b, s, number, 1 - turn if turn >= 0 else 0) for b, s in sorted((slots | to).items())], "bucket int, slot int, number long, turn int")
    said.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(f"{path}/manifest")
    return changed
