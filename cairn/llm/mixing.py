"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a weight and a schedule: a piecewise linear density over training time 0..1. The words a source
owes in total come from the weights (`source_targets`); its schedule, integrated, says how many it owes by time t.
Documents of a source stand in a fixed hashed order, so each copy of a document fills an interval of the source's word
stream, and inverting the cumulative demand at that interval gives its training position. The stream is range-sorted
by position.

A hot source never lands in one task: running word counts are taken inside (source, hash bucket) cells and lifted by the
sums of the cells before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, load, let, stash, unused

WEIGHTS = (5, 2, 1)
#: Knot times shared by all schedules, and the densities of the sources in turn: fading, level, rising.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Cells of a source hold about so many rows.
CELL_ROWS = 4096


def source_targets(sums: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source (``skey``, ``source_size``): its rank, and ``target`` words.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words. A target
    stops at ``epochs`` times its source's size and the excess is shared again by weight. That fixed point is a water
    level: with sources sorted by cap per weight, those below the level are full and the rest get weight times level.
    """
    turn = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    ranked = sums.withColumn("rank", F.row_number().over(turn) - 1).withColumn("weight", w).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    demand = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (demand - full_before) / weight_left
    levelled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    at = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("weight") * at, F.col("cap")))).select("skey", "rank", "source_size", "target")


def invert_schedule(u: Column, rank: Column, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time by which share ``u`` of a source's words is owed, for the schedule that its rank picks.

    The density is linear between knots, so the demand is quadratic there: find the segment, then solve it.
    """
    out = F.lit(None).cast("double")
    for turn, density in enumerate(schedules):
        areas = [(knots[i + 1] - knots[i]) * (density[i] + density[i + 1]) / 2 for i in range(len(knots) - 1)]
        whole, before, at = sum(areas), 0.0, F.lit(float(knots[-1]))
        for i in reversed(range(len(areas))):
            before = sum(areas[:i])
            span, d0 = knots[i + 1] - knots[i], density[i]
            slope = (density[i + 1] - d0) / span
            rest = F.least(F.greatest(u * whole - F.lit(before), F.lit(0.0)), F.lit(areas[i]))
            inside = 2 * rest / (F.lit(d0) + F.sqrt(F.greatest(F.lit(d0 * d0) + 2 * slope * rest, F.lit(0.0)))) if d0 or slope else F.lit(0.0)
            at = F.when(u * whole <= F.lit(before + areas[i]), F.lit(float(knots[i])) + inside).otherwise(at)
        out = F.when(rank % len(schedules) == turn, at).otherwise(out)
    return out


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per input row: the id, ``size``, ``source_size``, ``target``, ``taken``, ``position``, ``taken_by_copy``, ``positions``.

    ``taken`` counts words over all copies; the copy at a source's target is cut there, so a source's words meet its
    target to within half a word. ``position`` is that of the first copy (null: not taken); ``positions`` has one entry
    per copy. A null text has no words; a null source is a source of its own; equal rows are taken as separate
    documents; an empty table gives no rows; further columns are ignored.
    """
    return _plan(_sized(docs, id_col, text_col, source_col), weights, share, epochs).withColumnRenamed("id", id_col)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, more: Sequence[str] = ()) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return stash(docs.select(F.col(id_col).alias("id"), key.alias("skey"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("h"), *more), "sized")


def _plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2, more: Sequence[str] = ()) -> DataFrame:
    bits = min(40, max(4, (sized.count() // CELL_ROWS).bit_length()))  # the more rows, the more cells; the plan is the same with any number
    sized = sized.withColumn("cell", F.shiftright("h", 60 - bits))
    cells = sized.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), weights, share, epochs)
    before = F.coalesce(F.sum("cell_size").over(Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("skey", "cell", before.alias("cell_start")).join(targets, "skey")
    inside = Window.partitionBy("skey", "cell").orderBy("h", "id", "size", *more)
    start = F.col("cell_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.join(cells, ["skey", "cell"]).withColumn("start", start)
    words = F.round("target").cast("long")
    took = [F.greatest(F.least(words - F.lit(e) * F.col("source_size") - F.col("start"), F.col("size")), F.lit(0)) for e in range(epochs)]
    placed = placed.withColumn("taken_by_copy", F.array(*took))
    at = [F.when(F.col("taken_by_copy")[e] > 0, invert_schedule((F.lit(e) * F.col("source_size") + F.col("start") + F.col("taken_by_copy")[e] / 2) / F.col("target"), F.col("rank"))) for e in range(epochs)]
    return placed.select("id", *more, "size", "source_size", "target", F.aggregate("taken_by_copy", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), at[0].alias("position"), "taken_by_copy", F.array(*at).alias("positions"))


def range_sorted(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows in training order over range partitions; what is not taken comes last."""
    return plan.orderBy(F.col("position").asc_nulls_last(), id_col)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The training stream: each taken copy of each row once, in order of position.

    The columns of ``docs`` stay as they are; the text of a copy that its source's target cuts holds the words before
    the cut, joined by spaces. Rows are told apart by a 128-bit hash of all their columns; the copies planned for equal
    rows are all made from one of them. Null and empty texts have no words and are not taken; an empty table gives no rows.
    """
    kind, own_size, copy = [unused(docs, "k1"), unused(docs, "k2")], unused(docs, "size"), unused(docs, "copy")
    cells = [F.col(c) for c in docs.columns] + [F.col(c).isNull() for c in docs.columns]
    marked = docs.withColumns({kind[0]: F.xxhash64(*cells), kind[1]: F.xxhash64(F.lit(1), *cells)})
    sized = _sized(marked, id_col, text_col, source_col, kind)
    plan = _plan(sized, weights, share, epochs, kind)
    copies = plan.select(*kind, F.col("size").alias(own_size), F.explode(F.arrays_zip(F.col("taken_by_copy").alias("n"), F.col("positions").alias("at"))).alias(copy)).where(F.col(copy)["n"] > 0)
    again = stash(sized.groupBy(*kind).agg(F.count("*").alias("n")).where("n > 1").select(*kind), "again")
    if not again.isEmpty():
        marked = marked.join(again, kind, "left_anti").unionByName(marked.join(again, kind, "left_semi").dropDuplicates(kind))
    hit = marked.join(copies, kind)
    n, short = F.col(copy)["n"], F.col(copy)["n"] < F.col(own_size)
    cut = let(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), lambda w: F.array_join(F.slice(w, F.lit(1), n.cast("int")), " "))
    shaped = hit.withColumn(text_col, F.when(short, cut).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        shaped = shaped.withColumn("n_chars", F.when(short, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return shaped.orderBy(F.col(copy)["at"], id_col).select(*docs.columns)


def op2_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(load(spark, sf_dir, "documents"))
    return range_sorted(plan).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


#: The same plan said in SQL: targets by the water level, the stream by running sums over the hashed order.
SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(rnk % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rnk FROM sums)),
levelled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT skey, rnk, source_size, CASE WHEN cap <= level * weight THEN cap ELSE least(weight * max(CASE WHEN cap > level * weight THEN level END) OVER (), cap) END AS target
  FROM levelled),
placed AS (
  SELECT s.*, t.rnk, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t USING (skey)),
took AS (
  SELECT *, greatest(least(CAST(round(target) AS BIGINT) - start, size), 0) AS t1,
         greatest(least(CAST(round(target) AS BIGINT) - source_size - start, size), 0) AS t2
  FROM placed),
timed AS (SELECT *, (start + t1 / 2.0::DOUBLE) / target AS u FROM took)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
       CASE WHEN t1 > 0 THEN round(CASE rnk % 3
         WHEN 1 THEN u
         WHEN 0 THEN CASE WHEN u <= 0.625 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u)) ELSE 0.5 + 2 * (u - 0.625) / (1 + sqrt(1 - 2 * (u - 0.625))) END
         ELSE CASE WHEN u <= 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u)) ELSE 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375))) END END, 6) END AS position
FROM timed
"""
