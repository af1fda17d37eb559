"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def _starred(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): tie the neighbours v of every u to the smallest of u and its neighbours.

    The minimum is a partial aggregate; the hub's edges meet it in a join, whose skewed side
    adaptive execution splits. No neighbour list is ever collected."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u")
    if larger_only:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                             F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, in any direction, with repeats and loops -> (node, root): every node
    of a proper edge with the smallest node of its component. Null ends are left out. Each round
    is a written table; rounds grow with the logarithm of the longest chain."""
    pairs = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "edges")
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_starred(both, True), "large-star")
        pairs = stored(_starred(large, False), "small-star")
