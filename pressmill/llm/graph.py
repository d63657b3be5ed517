"""Connected components of an edge table, with stars instead of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressmill.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id reachable, for every id that is not itself the smallest of its component.

    ``edges``: columns ``u``, ``v`` (longs; loops, repeated and reversed rows allowed). Large and small stars alternate until
    nothing changes; every step takes the smallest neighbour by an aggregate with partial sums and a join, never a list of
    neighbours, and writes its edges to the shared folder.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = settle(small)
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
