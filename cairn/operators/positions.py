"""Phrases from an index of term positions, written once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cairn.functions.text import tokens
from cairn.operators.search import SMALL_QUERIES

#: Files are laid out by the hash of the term in so many folders; a query reads those of its terms.
FOLDERS = 64
#: Words that are grouped at once.
WORDS = 1_000_000


def folder_of(term):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, term, positions``: the terms of each row with their places in order, made inside the row's batch."""
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)  # rows of about WORDS words, one at least
                yield grouped(ids.slice(lo, hi - lo), lists.values.slice(ends[lo], ends[hi] - ends[lo]), np.diff(ends[lo : hi + 1]))
                lo = hi

    return rows.where(F.size("t") > 0).mapInArrow(run, StructType([StructField("doc_id", kind), StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


def grouped(ids: pa.Array, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    """The postings of some rows: their words in one array, ``sizes`` of them each. No row is empty."""
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = code * len(sizes) + row
    order = np.argsort(key, kind="stable")  # by term, then row, then place
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row[order[first]])), coded.dictionary.take(pa.array(code[order[first]])), places], ["doc_id", "term", "positions"])


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Positional postings (term, doc_id, positions) under ``path``, in folders by term and sorted by it inside the files.

    Each task writes the terms of its own rows to a file in each folder, so that nothing is shuffled and a common term is
    no hot key. Null texts have no terms.
    """
    laid = postings(docs, id_col, text_col).withColumn("folder", folder_of("term"))
    laid.sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(path)


def asked_terms(phrases: DataFrame) -> DataFrame:
    """``query_id, term, offset, n``: each phrase's terms by place; phrases without a term are left out."""
    words = phrases.select("query_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return words.select("query_id", F.size("t").alias("n"), F.posexplode("t").alias("offset", "term"))


def phrase_matches(spark: SparkSession, path: str, phrases: DataFrame) -> DataFrame:
    """``query_id, doc_id, found``: documents that hold the phrase, and how often, for a table of phrases (query_id, text).

    Only folders of asked terms are read. A phrase is looked for in the documents that have the rarest of its terms: of
    these, the starts that this term leaves are held against each other term's positions, less its offset. So what is
    shuffled are the asked terms' postings once and the starts by the rarest terms, not every posting for every phrase.
    """
    asked = asked_terms(phrases)
    folders = [r.folder for r in asked.select(folder_of("term").alias("folder")).distinct().collect()]  # FOLDERS at most
    size = asked.agg(F.sum(F.length("term") + 24)).first()[0] or 0
    beside = F.broadcast if size <= SMALL_QUERIES else (lambda df: df)
    index = spark.read.parquet(path).where(F.col("folder").isin(folders)).join(beside(asked.select("term").distinct()), "term", "left_semi")
    often = index.groupBy("term").agg(F.count("*").alias("documents"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("documents", "term", "offset"))
    known = asked.join(beside(often), "term", "left").withColumn("turn", first)
    lacking = known.where(F.col("documents").isNull()).select("query_id")  # a term that no document has
    rarest = known.where(F.col("turn") == 1).join(lacking, "query_id", "left_anti").select("query_id", "term", "n", F.col("offset").alias("own"))
    starts = index.join(beside(rarest), "term").select("query_id", "doc_id", "n", "own", F.transform("positions", lambda p: p - F.col("own")).alias("starts")).where(F.exists("starts", lambda p: p >= 0))
    rest = asked.select("query_id", F.col("offset"), F.col("term").alias("other"))
    wanted = starts.join(beside(rest), "query_id").where(F.col("offset") != F.col("own"))
    wanted = wanted.select("query_id", "doc_id", "n", "starts", "offset", F.col("other").alias("term"))
    others = index.select(F.col("term").alias("_term"), F.col("doc_id").alias("_doc_id"), "positions")
    met = wanted.join(others, (F.col("term") == F.col("_term")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    kept = met.select("query_id", "doc_id", "n", F.array_intersect("starts", F.transform("positions", lambda p: p - F.col("offset"))).alias("starts")).where(F.size("starts") > 0)
    lists = kept.groupBy("query_id", "doc_id", "n").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("n") - 1)
    common = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    longer = lists.select("query_id", "doc_id", F.size(common).alias("found"))
    return longer.union(starts.where("n = 1").select("query_id", "doc_id", F.size("starts"))).where("found > 0")
