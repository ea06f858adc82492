"""Connected components of an edge list by alternating large-star and small-star steps.

Both steps only take minima per node (combined before the shuffle) and join them back, so a
hub with a third of all edges is split by the skew-join rule and never gathered in one task.
The edges of each round are written to the shared folder, what is made in between is kept on the
executors within the round; the driver sees one number a round. Rounds grow with the logarithm of
the number of nodes; after ``max_rounds`` it is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sonorel.llm.work import discard, held, stored


def _astray(e: DataFrame) -> int:
    """Nodes that keep ``e(u, v)`` with u > v from being stars around their smallest nodes."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per_node.where("down > 1 or (down = 1 and up = 1)").count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs, any direction, repeats and loops allowed.

    Returns ``(node, component)``, one row per node of a non-loop edge, component being the
    smallest node reachable. No edges: no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if not _astray(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = held(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = held(large)
        down = held(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(low, large, down, before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
