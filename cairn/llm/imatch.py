"""Document fingerprints by I-Match over randomised lexicons. DataFrame functions only.

Terms whose document frequency lies in a band form the lexicon. A document keeps its distinct lexicon terms in sorted order
and hashes those that fall into each of several random subsets of the lexicon; the hashes side by side are its fingerprint,
and the share of equal hashes is the likeness of two documents.

The lexicon becomes an array literal of the plan. Its size has a bound that does not grow with the corpus: each of its terms
is in a share ``low`` of all documents at least, so there are at most (mean distinct terms of a document) / ``low`` of them.
With it, a fingerprint is a projection: no term is shuffled after counting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, load, text_of, unused

TERM = r"[\p{L}\p{N}]+"
SUBSETS = 8
#: A term is in subset k if hex digit k of its md5 is below this one: 5 of 16.
BELOW = "5"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def lexicon(docs: DataFrame, *, text_col: str = "text", low: float = 0.02, high: float = 0.2) -> list[str]:
    """The sorted terms with a document frequency from ``low`` to ``high`` of all rows: the chosen band of idf.

    A term counts once a row, repeated rows count each, a null text has none; an empty table has an empty lexicon.
    """
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(terms(text_of(text_col)))).alias("term"))
    band = each.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= low * n) & (F.col("df") <= high * n))
    return sorted((r.term for r in band.select("term").collect()), key=lambda t: t.encode())


def fingerprint(text: Column, words: list[str], subsets: int = SUBSETS) -> Column:
    """An array of hashes, one for each lexicon subset.

    A subset without a term of the document takes the hash of all its lexicon terms, and a document without lexicon
    terms that of its lower-cased text, so short documents do not meet in empty sets.
    """
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)
    lex = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    kept = F.transform(F.array_intersect(lex, terms(text)), lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("h")))

    def one(pairs: Column, k: int) -> Column:
        mine = F.array_join(F.transform(F.filter(pairs, lambda p: F.substring(p["h"], k + 1, 1) < BELOW), lambda p: p["t"]), " ")
        return let(mine, lambda s: short(F.when(s == "", F.array_join(F.transform(pairs, lambda p: p["t"]), " ")).otherwise(s)))

    return let(kept, lambda p: F.when(F.size(p) == 0, F.array_repeat(short(F.concat(F.lit("text "), F.lower(text))), subsets)).otherwise(F.array(*[one(p, k) for k in range(subsets)])))


def likeness(a: Column, b: Column, subsets: int = SUBSETS) -> Column:
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.lit(float(subsets))


def fingerprints(docs: DataFrame, *, text_col: str = "text", words: list[str] | None = None, **band) -> DataFrame:
    """``docs`` with ``fingerprint`` (hashes joined by dashes) and ``fingerprint_parts``.

    A null text counts as empty. Equal texts, so repeated rows too, have equal fingerprints; texts of any length are read
    whole; an empty table gives no rows. Columns with the new names are replaced, all others pass through.
    """
    words = lexicon(docs, text_col=text_col, **band) if words is None else words
    made = docs.withColumn("fingerprint_parts", fingerprint(text_of(text_col), words))
    return made.withColumn("fingerprint", F.array_join("fingerprint_parts", "-"))


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (null: none), by bisection in the expression."""
    if not bounds:
        return F.lit(0)
    marks = F.array(*[F.lit(b) for b in bounds])

    def halve(state: Column, _: Column) -> Column:
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        right = (state["lo"] < state["hi"]) & F.coalesce(F.get(marks, mid) <= value, F.lit(False))
        return F.struct(F.when(right, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(right, state["hi"]).otherwise(F.least(mid, state["hi"])).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)
    return found["lo"]


def with_next(rows: DataFrame, id_col: str, carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows, rows_per_bucket: int = 512, most_buckets: int = 20_000) -> DataFrame:
    """``derive(rows)`` with ``next`` (all its columns, of the next row): the row after it in descending order of a whole-number id, after the last the first.

    Buckets are ranges of ids of about equal size, from approximate quantiles, so that no task orders all rows; beyond
    ``rows_per_bucket * most_buckets`` rows they grow, and a task sorts its bucket with spilling. A window finds the next row
    inside a bucket; a bucket's last row gets the first row of the bucket below. Equal ids are ordered by the
    ``carried`` columns; null ids come last. ``derive`` adds columns row by row; of the first rows they are made again.
    """
    bucket, turn, after, head, below, to, top = (unused(rows, c) for c in ("bucket", "turn", "after", "head", "below", "to", "top"))
    n = rows.count()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts = rows.agg(F.percentile_approx(F.col(id_col), [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0] if buckets > 1 else None
    bucketed = rows.withColumn(bucket, range_bucket(F.col(id_col), sorted(set(cuts or []))))
    order = Window.partitionBy(bucket).orderBy(F.col(id_col).desc_nulls_last(), *carried)
    heads = derive(bucketed.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1))
    made = [c for c in heads.columns if c not in (bucket, turn)]
    heads = heads.select(F.col(bucket).alias(below), F.struct(*made).alias(head))
    placed = derive(bucketed).withColumn(after, F.lead(F.struct(*made)).over(order))
    down = Window.orderBy(F.col(below).desc())
    links = heads.select(below, F.lead(below).over(down).alias(to), F.max(below).over(Window.partitionBy()).alias(top))
    heads = links.select(F.col(below).alias(bucket), F.coalesce(to, top).alias(below)).join(heads, below).drop(below)
    joined = placed.join(heads, (placed[bucket] == heads[bucket]) & placed[after].isNull(), "left")
    return joined.select(*made, F.coalesce(after, head).alias("next"))


def op10_imatch(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    words = lexicon(docs)
    pairs = with_next(docs, "doc_id", ["text"], lambda rows: rows.withColumn("fp", fingerprint(F.col("text"), words))).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring(F.col("next.text"), F.lit(1), half))
    done = pairs.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), let(edited, lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), fingerprint(t, words).alias("fp"))).alias("e"))
    return done.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), F.array_join("fp", "-").alias("fingerprint"), F.array_join("e.fp", "-").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


_PARTS = ", ".join(
    f"substr(md5(coalesce(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5(term), {k + 1}, 1) < '{BELOW}'), string_agg(term, ' ' ORDER BY term))), 1, 16)" for k in range(SUBSETS)
)
_LIKE = lambda a, b: "(" + " + ".join(f"({a}[{k + 1}] = {b}[{k + 1}])::INT" for k in range(SUBSETS)) + f") / {SUBSETS}.0::DOUBLE"
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(text) OVER d, first_value(text) OVER d) AS nxt, coalesce(lead(doc_id) OVER d, first_value(doc_id) OVER d) AS next_id
      FROM t WINDOW d AS (ORDER BY doc_id DESC)),
v AS (SELECT doc_id, 0 AS v, text FROM e UNION ALL
      SELECT doc_id, 1, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) FROM e),
w AS (SELECT DISTINCT doc_id, v, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM v),
band AS (SELECT term FROM w WHERE v = 0 GROUP BY term HAVING count(*) >= 0.02 * (SELECT count(*) FROM t) AND count(*) <= 0.2 * (SELECT count(*) FROM t)),
f AS (SELECT doc_id, v, [{_PARTS}] AS fp FROM w JOIN band USING (term) GROUP BY doc_id, v),
a AS (SELECT v.doc_id, v.v, v.text, coalesce(f.fp, list_transform(range({SUBSETS}), lambda i: substr(md5('text ' || lower(v.text)), 1, 16))) AS fp FROM v LEFT JOIN f USING (doc_id, v))
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(b.text) AS edited_sha256, array_to_string(o.fp, '-') AS fingerprint, array_to_string(b.fp, '-') AS edited_fingerprint,
       {_LIKE("o.fp", "b.fp")} AS near_edited, {_LIKE("o.fp", "n.fp")} AS near_next
FROM e JOIN a o ON o.doc_id = e.doc_id AND o.v = 0 JOIN a b ON b.doc_id = e.doc_id AND b.v = 1 JOIN a n ON n.doc_id = e.next_id AND n.v = 0
"""
