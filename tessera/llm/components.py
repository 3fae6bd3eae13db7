"""Connected components of a distributed edge list, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the smallest node reachable.

    Alternates the large-star and small-star steps until no edge changes. Every step is
    two shuffles with pre-aggregated minima and is checkpointed, so a lost executor costs
    one step. Large-star cuts only links to larger neighbours, so a hub's row count is
    its degree and the grouping side is a plain minimum. An empty list gives no rows.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    told = _sum(e)
    while True:
        # Large-star: every larger neighbour of a node goes to the least of its neighbourhood.
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        # Small-star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = _sum(e)
        if now == told:
            break
        told = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sum(e: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
