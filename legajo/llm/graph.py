"""Connected components by alternating stars, with each round's edges written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link larger neighbours of u to the least of its neighbourhood; small star: the smaller ones.

    The least neighbour of a node comes from a grouping that combines before the shuffle; joining it back is an
    ordinary join, of which Spark splits hot nodes.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        new = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, longs); component: the smallest node it reaches.

    Self-links, repeated and reversed links are allowed. Rounds grow with the logarithm of the longest chain.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark or not found["n"]:
            break
        mark = (found["n"], found["h"])
        now = stored(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = labels.unionAll(roots)
    return known.unionAll(loops.join(known.select("node"), "node", "left_anti"))
