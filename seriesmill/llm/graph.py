"""Connected components of a table of links, by rounds of random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of ``links`` (a, b: long); component is the least node of it.

    In each round every node points to the neighbour (or itself) that comes first in a random order drawn for
    the round, and links are renamed along the pointers; the links left shrink by a constant share, whatever the
    shape (chains, stars).  Each round is written to the shared folder.  A node's links never meet in
    one task: minima are pre-aggregated.  Links with a null end, of a node with itself, and repeated ones don't matter;
    a node that has no other link has no row.  An empty table gives none.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = F.xxhash64(F.lit(turn), "u")
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        both = both.unionByName(both.select("v", F.col("v").alias("u")).distinct())
        first = both.groupBy("v").agg(F.min(F.struct(order.alias("o"), "u")).alias("m")).select("v", F.col("m.u").alias("to"))
        step = written(first)
        steps.append(step)
        a, b = step.select(F.col("v").alias("a"), F.col("to").alias("x")), step.select(F.col("v").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = steps[-1].select("v", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = root.select(F.col("v").alias("to"), "root")
        root = step.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    root = written(root)
    least = written(root.groupBy("root").agg(F.min("v").alias("component")))
    return root.join(least, "root").select(F.col("v").alias("node"), "component")
