"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Each round links every node's larger neighbours (large star), then its smaller ones (small star), to
    the node's least neighbour; the edges end as one star per component. Minima are partial aggregates, and
    both sides of every join are tables of their own, so that adaptive execution can split a hub's rows.
    Only two sums reach the driver each round. Self-loops and repeated edges are harmless; an empty table
    gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = checkpointed(now)
    state = None
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = checkpointed(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        floor = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(floor, "u")
        now = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(now.select("e.*").where("u <> v").distinct())
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(sums):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(sums)
    raise RuntimeError("components did not settle")
