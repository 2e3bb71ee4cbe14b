"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on edges (u, v): each node's later (large) or earlier (small) neighbours move to its smallest neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if not small else both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if small:  # v < u here: all earlier neighbours and the node itself
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (u, v) the smallest node of its component; no edges give no rows, null ends are left out.

    Each round writes its edges to the shared folder, so a lost executor costs a round
    at most; the number of rounds grows with the logarithm of a component's length.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state[0] == 0 or state == seen:
            break
        seen, before = state, now
        now = written(_star(_star(now, small=False), small=True), "edges")
        dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
