"""Paths with their nodes, and chains of steps to the next dearer item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.graph import undirected
from cairn.sources.shared import cut

#: Buckets of prices for each factor of e: a bucket spans half a percent.
FINE = 200


def shortest_lists(edge_table: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``start, node, hops, path``: for all nodes within ``hops`` of each start one shortest list of nodes, the least in order.

    Level by level, each node reached once: of the lists that reach it first the least one is kept, which grouping does in
    parts, so a node with many edges is no hot key. A list has at most ``hops`` + 1 nodes. Levels are cut in the shared folder.
    """
    both = undirected(edge_table)
    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")))
    front = seen
    for level in range(1, hops + 1):
        step = front.select("start", F.col("node").alias("u"), "path").join(both, "u").select("start", F.col("v").alias("node"), "path")
        fresh = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        front = cut(fresh.select("start", "node", F.lit(level).alias("hops"), F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def next_above(probes: DataFrame, rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, above, value, id``: for each distinct (``by``, ``above``) of the probes the row with the least value above it, ties by least id.

    ``rows`` is (by, value, id). An as-of join: both sides are sorted inside (by, bucket of the value), with one row for each
    distinct value, so that neither a frequent key nor a frequent value makes a large group; where the bucket has nothing above, the
    least row of the next bucket with any is taken. Values must be positive; probes with nothing above give no row.
    """
    bucket = lambda c: F.floor(F.log(c) * FINE)
    r = rows.where(F.col(value) > 0).groupBy(by, value).agg(F.min("id").alias("id")).select(by, bucket(F.col(value)).alias("b"), F.col(value).alias("at"), F.struct(F.col(value).alias("value"), "id").alias("hit"))
    p = probes.where("above > 0").select(by, "above").distinct().select(by, bucket(F.col("above")).alias("b"), F.col("above").alias("at"), F.lit(None).cast(r.schema["hit"].dataType).alias("hit"))
    both = r.unionByName(p)
    greater = Window.partitionBy(by, "b").orderBy(F.desc("at"), F.col("hit").isNotNull().asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("next", F.last("hit", ignorenulls=True).over(greater)).where("hit IS NULL")
    later = Window.partitionBy(by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = both.groupBy(by, "b").agg(F.min("hit").alias("least")).withColumn("later", F.last("least", ignorenulls=True).over(later)).drop("least")
    found = inside.join(beyond, [by, "b"]).select(by, F.col("at").alias("above"), F.coalesce("next", "later").alias("hit"))
    return found.where("hit IS NOT NULL").select(by, "above", F.col("hit.value").alias(value), F.col("hit.id").alias("id"))


def upgrades(priced: DataFrame, facts: DataFrame, low: float = 1.2, high: float = 2.0) -> DataFrame:
    """``start, mid, end``: from each item over a shared feature to the cheapest one dearer by a factor between ``low`` and ``high``, from
    that over a feature that the start lacks to the cheapest one dearer than it by such a factor. Ties go by least id.

    ``priced`` is (id, price), ``facts`` distinct (id, feature). Items without both steps give no row.
    """
    held = facts.join(priced, "id")

    def step(asked: DataFrame) -> DataFrame:
        """The cheapest next item over all features of each asked (start, feature, price)."""
        above = asked.withColumn("above", F.col("price") * low)
        hits = next_above(above, held.select("feature", F.col("price").alias("value"), "id"), "feature", "value")
        return above.join(hits, ["feature", "above"]).where(F.col("value") < F.col("price") * high).groupBy("start").agg(F.min(F.struct("value", "id")).alias("to"))

    first = cut(step(held.select(F.col("id").alias("start"), "feature", "price")))
    news = first.join(facts, F.col("to.id") == facts.id).select("start", "feature", F.col("to.value").alias("price"))
    fresh = news.join(facts.select(F.col("id").alias("start"), "feature"), ["start", "feature"], "left_anti")
    second = step(fresh)
    return first.select("start", F.col("to.id").alias("mid")).join(second.select("start", F.col("to.id").alias("end")), "start")


def first_shared(a: Column, b: Column, without: Column | None = None, most: int = 2) -> Column:
    """The first ``most`` values in order that both lists have and ``without`` has not."""
    both = F.array_intersect(a, b)
    return F.slice(F.array_sort(both if without is None else F.array_except(both, without)), 1, most)
