"""Connected components of a graph given as edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the smallest node of the component.

    Alternates two star steps until nothing changes: each node hands its larger neighbours, then its
    smaller ones, to its smallest neighbour. Every step is one aggregate and one join on the node, which
    may be skewed: the minimum is pre-aggregated and the join can be split. Each round is a written table,
    so a lost executor repeats one round at most. Only a count and a digest come to the driver. Empty
    edges give an empty result.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(near, F.col("u") == F.col("k"))
        new = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(now)
        now = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
