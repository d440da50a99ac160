"""Node and edge tables, and analytics over them as joins and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.sources.shared import cut


def nodes(df: DataFrame, kind: str, key: Column, **attributes: Column) -> DataFrame:
    """Distinct nodes with a namespaced ``graph_node_id`` and their label."""
    return df.select(F.concat(F.lit(kind + ":"), key.cast("string")).alias("graph_node_id"), F.lit(kind).alias("node_label"), *[c.alias(n) for n, c in attributes.items()]).distinct()


def edges(df: DataFrame, kind: str, source: tuple[str, Column], target: tuple[str, Column], weight: Column | None = None) -> DataFrame:
    ids = [F.concat(F.lit(k + ":"), c.cast("string")) for k, c in (source, target)]
    return df.select(ids[0].alias("from_id"), ids[1].alias("to_id"), F.lit(kind).alias("relationship_type"), (F.lit(1.0) if weight is None else weight).alias("weight")).where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()


def dangling(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which."""
    ids = node_table.select(F.col("graph_node_id").alias("id"))
    ends = edge_table.select("from_id", "to_id", "relationship_type", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_id").alias("id")), F.struct(F.lit("to").alias("end"), F.col("to_id").alias("id")))).alias("e")).select("from_id", "to_id", "relationship_type", "e.*")
    return ends.join(ids, "id", "left_anti")


def links_within(members: DataFrame, item: str, group: str, part: int = 2000) -> DataFrame:
    """``a, b``: the links between all different items of a group, both ways; the rows of ``members`` are distinct.

    A group is dealt into parts of about ``part`` items, and each part meets each on a key of its own, so a large group is
    the work of many tasks and none holds it whole.
    """
    rows = members.select(F.col(item).alias("i"), F.col(group).alias("g"))
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own, every = F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.join(parts, "g")
    a, b = dealt.select("g", own.alias("pa"), every.alias("pb"), F.col("i").alias("a")), dealt.select("g", every.alias("pa"), own.alias("pb"), F.col("i").alias("b"))
    return a.join(b, ["g", "pa", "pb"]).where("a <> b").select("a", "b")


def pair_counts(facts: DataFrame, item: str, feature: str, least: int = 1, most_per_item: int | None = None) -> DataFrame:
    """``a, b, together``: how many items have both features, ``a < b``.

    Features of an item are listed in its own row and paired there, so a popular feature is no hot key; what is shuffled
    is counted before.
    """
    lists = facts.select(item, feature).distinct().groupBy(item).agg(F.array_sort(F.collect_set(feature)).alias("f"))
    if most_per_item:
        lists = lists.where(F.size("f") <= most_per_item)
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def shared_pairs(facts: DataFrame, item: str, feature: str, least: int = 1) -> DataFrame:
    """``a, b, together``: pairs of items ``a < b`` with at least ``least`` common features, and how many they have.

    Each item's features are put in order, rare ones first. Two items with ``least`` common features out of n have one
    among the first n - ``least`` + 1 of either, so only these are met on; common features join no rows unless an item has
    nothing rarer. A pair counts where its first common feature is met, so it comes once without being grouped.
    """
    once = facts.select(item, feature).distinct()
    often = once.groupBy(feature).agg(F.count("*").alias("n"))
    lists = once.join(often, feature).groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", feature))), lambda x: x[feature]).alias("f"))
    rows = lists.where(F.size("f") >= least).select(F.col(item).alias("i"), "f", F.explode(F.slice("f", F.lit(1), F.size("f") - (least - 1))).alias("met"))
    a, b = rows.select(F.col("i").alias("a"), F.col("f").alias("fa"), "met"), rows.select(F.col("i").alias("b"), F.col("f").alias("fb"), "met")
    both = a.join(b, "met").where("a < b").withColumn("common", F.array_intersect("fa", "fb"))
    return both.where((F.get("common", F.lit(0)) == F.col("met")) & (F.size("common") >= least)).select("a", "b", F.size("common").cast("long").alias("together"))


def lift(facts: DataFrame, item: str, feature: str, least: int = 5) -> DataFrame:
    """Feature pairs with lift = together x items / (count a x count b)."""
    single = facts.select(item, feature).distinct().groupBy(feature).agg(F.count("*").alias("n"))
    total = facts.select(item).distinct().agg(F.count("*").alias("items"))
    a, b = single.select(F.col(feature).alias("a"), F.col("n").alias("na")), single.select(F.col(feature).alias("b"), F.col("n").alias("nb"))
    joined = pair_counts(facts, item, feature, least).join(a, "a").join(b, "b").join(F.broadcast(total))  # one row
    return joined.select("a", "b", "together", (F.col("together") * F.col("items") / (F.col("na") * F.col("nb"))).alias("lift"))


def frequent_sets(facts: DataFrame, item: str, feature: str, least: int = 5, size: int = 3) -> DataFrame:
    """``features, together, lift``: sets of ``size`` features or more that at least ``least`` items have, in order, by parallel pattern growth.

    Lift is the share of items with the set over the product of its features' shares. Counts are summed from parts of the table; a
    feature that fewer items have is left out before anything grows from it.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = facts.where(F.col(feature).isNotNull()).groupBy(item).agg(F.collect_set(feature).alias("items"))
    total = baskets.count()
    if not total:
        return facts.sparkSession.createDataFrame([], "features array<string>, together long, lift double")
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total), minConfidence=1.0).fit(baskets).freqItemsets
    single = found.where(F.size("items") == 1).select(F.col("items")[0].alias("feature"), F.log(F.col("freq") / total).alias("part"))
    sets = found.where(F.size("items") >= size).select(F.array_sort("items").alias("features"), F.col("freq").alias("together"))
    summed = sets.withColumn("feature", F.explode("features")).join(single, "feature").groupBy("features", "together").agg(F.sum("part").alias("apart"))
    return summed.select("features", "together", F.exp(F.log(F.col("together") / total) - F.col("apart")).alias("lift"))


def premium(facts: DataFrame, feature: str, value: str, totals: DataFrame, baseline: int = 10) -> DataFrame:
    """Mean value of items with a feature against those without: the rest is the totals less the feature's own sums."""
    by = facts.groupBy(feature).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    joined = by.join(F.broadcast(totals.agg(F.count("*").alias("all_n"), F.sum(value).alias("all_s")))).where(F.col("all_n") - F.col("n") >= baseline)  # one row
    rest = (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    return joined.select(feature, "n", (F.col("s") / F.col("n")).alias("with_avg"), rest.alias("without_avg"), ((F.col("s") / F.col("n") - rest) / rest * 100).alias("percent"))


def undirected(edge_table: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    one = edge_table.select(F.col(a).alias("u"), F.col(b).alias("v"))
    return one.union(one.select("v", "u")).distinct()


def shortest_paths(edge_table: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``start, node, hops`` for all nodes within ``hops`` of each start: level by level, each reached once.

    Levels are cut with checkpoint(), which all executors share.
    """
    both = undirected(edge_table)
    seen = cut(starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("hops")))
    front = seen
    for level in range(1, hops + 1):
        step = front.join(both, front.node == both.u).select("start", F.col("v").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def degrees(edge_table: DataFrame) -> DataFrame:
    return undirected(edge_table).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def component_labels(edge_table: DataFrame) -> DataFrame:
    """``node, label``: the least node that is connected, by minimum labels that jump to their label's label, until none changes."""
    both = cut(undirected(edge_table))
    labels = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.u).select("node", F.least("label", "near").alias("label"))
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(stepped.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")))
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def top_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
