"""Scans of JSON files and of folders of pages or texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_files(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Rows of several JSON files, each an array of objects, with the file's name; the schema is given, not guessed."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("source_file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Rows of files or folders with one JSON object a line, which Spark can split, with the file's name."""
    return spark.read.schema(schema).json(paths).withColumn("source_file", F.col("_metadata.file_name"))


def jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table in parallel ranges of a numeric key."""
    options = {"url": url, "dbtable": f"({query}) t", "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def folder(spark: SparkSession, path: str, pattern: str = "*.html", whole: bool = True, separator: str | None = None) -> DataFrame:
    """``path, text`` of each file of a folder, lazily; ``whole`` False gives a row per line, or per text that ``separator`` ends."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    read = reader.text(path, wholetext=whole, pathGlobFilter=pattern, recursiveFileLookup=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
