"""Connected components of an edge table by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``pairs(a, b)`` other than the roots: the least node that it is connected to.

    In a round each node steps to the least node around it, and edges are kept between the nodes stepped to. The least
    node of a component never leaves itself, so it is what is left when no edge is. A group around its least node takes
    one round; node names in random order halve the rest in a round or better. Null nodes and loops are ignored.
    """
    edges, steps = stash(pairs.where("a <> b").select("a", "b"), "edges"), []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("v")))
        # a table of its own, so that the joins can split a node with very many neighbours
        step = stash(both.groupBy("node").agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("to")), "step")
        at = lambda c, step=step: step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        edges = stash(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps.pop()
    while steps:
        roots = steps.pop().join(roots.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    return roots.where("node <> to").select("node", F.col("to").alias("root"))
