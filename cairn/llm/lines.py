"""Line dedup over windows of three consecutive lines.

Every window of three lines that have a word is hashed; the first place of each window in the corpus, by document id and
line, stays, and a later place covers its lines. Covered lines of a document are merged and removed. Only hashes and
places are shuffled by window; texts move once, to meet the places that they lose. A document goes by its id and a hash
of its text, so different texts under one id are different documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, load, text_of, unused

BLANKS = " \t\n\x0b\x0c\r"


def worded_lines(text: Column) -> Column:
    """Lines with a word, without the white space around them, each with its number: array of (s, n)."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.trim(x, F.lit(BLANKS)).alias("s"), i.alias("n")))
    return F.filter(numbered, lambda x: x["s"] != "")


def windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id`` and text hash ``th`` of the document, the window's 128-bit hash ``h1, h2``, its place ``at``, and the numbers of its lines."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), worded_lines(text_of(text_col)).alias("l")).where(F.size("l") >= width)

    def one(i: Column) -> Column:
        s = [F.element_at("l", i + k)["s"] for k in range(width)]
        return F.struct(F.xxhash64(*s).alias("h1"), F.xxhash64(F.lit("again"), *s).alias("h2"), i.alias("at"), F.array(*[F.element_at("l", i + k)["n"] for k in range(width)]).alias("lines"))

    return lines.select("id", "th", F.inline(F.transform(F.sequence(F.lit(1), F.size("l") - (width - 1)), one)))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``th`` and ``gone``: the sorted line numbers that later places of repeated windows cover, where there are any.

    Only windows that repeat are joined back, so a window in a third of all documents is one row on the small side and
    a key that adaptive execution can split on the other.
    """
    found = windows(docs, id_col, text_col, width)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(~F.struct("id", "th", "at").eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the text less its repeated lines, plus ``n_lines`` and ``n_removed``.

    Lines without a word are in no window and stay. A null text is empty. Documents with fewer than ``width`` worded
    lines lose nothing; very long texts are read whole; an empty table gives no rows. Rows with equal ids and texts count as
    one document at one place, so neither loses lines to the other; rows with equal ids and other texts are documents of
    their own, in the order of a hash of the text. A null id sorts first. Columns named ``n_lines`` or ``n_removed`` are replaced, all others pass through.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own_id, own_th, own_gone, own_lines = (unused(docs, c) for c in ("id", "th", "gone", "lines"))
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, width=width).toDF(own_id, own_th, own_gone)
    given = docs.select(*kept).withColumn(text_col, text_of(text_col))
    both = given.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_th)), "left")
    counted = both.withColumns({own_lines: F.split(text_col, "\n", -1), "n_removed": F.coalesce(F.size(own_gone), F.lit(0))}).withColumn("n_lines", F.size(own_lines))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col(own_gone)), lambda i: F.get(own_lines, i))
    text = F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return counted.withColumn(text_col, text).select(*kept, "n_lines", "n_removed")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents after line dedup with the columns of ``docs``; one whose every worded line went is dropped."""
    packed = docs.select(id_col, text_col, F.struct(*docs.columns).alias("_row"))
    cut = dedup_lines(packed, id_col=id_col, text_col=text_col).where((F.col("n_removed") == 0) | F.col(text_col).rlike(WORD))
    changed = F.col("_row").withField(text_col, F.col(text_col))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(text_col).cast("long"))
    return cut.select(F.when(F.col("n_removed") > 0, changed).otherwise(F.col("_row")).alias("_row")).select("_row.*")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, unnest(range(len(l))) AS n, trim(unnest(l), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS s FROM t),
w AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos,
             lead(s, 1) OVER d AS s2, lead(s, 2) OVER d AS s3, lead(n, 1) OVER d AS n2, lead(n, 2) OVER d AS n3
      FROM s WHERE s <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT *, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, pos) AS turn FROM w WHERE s3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([n, n2, n3]) AS n FROM r WHERE turn > 1),
raw AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS s FROM t)
SELECT doc_id, count(*) AS n_lines, count(gone.n) AS n_removed,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY raw.n) FILTER (gone.n IS NULL), '')) AS kept_sha256
FROM raw LEFT JOIN gone USING (doc_id, n) GROUP BY doc_id
"""
