"""File streams: deduplicated upserts, and event-time histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cairn.sources.merge import merge


def source(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; one without is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark; state older than that is dropped."""
    return timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def histogram(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by window; in append mode a window is given once, when the watermark has passed it."""
    return timed(stream, time).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *by, "n")


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: list[Column], buckets: int = 64) -> StreamingQuery:
    """Keep the newest row of each key in the bucketed table under ``path`` (see ``sources.merge``); available input only, then stop.

    A batch writes the buckets of its keys only; one that runs again replaces its own result.
    """

    def run(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, keys, newest, buckets)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write the available input's result as Parquet under ``path``, then stop; complete results replace the last ones."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
