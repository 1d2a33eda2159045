"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import settled


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
        .unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every node of `links` (a, b; longs).

    Each round halves the depth of the trees; rounds end when the links no longer change.
    """
    now = settled(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def state(frame: DataFrame) -> tuple:
        row = frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        return tuple(row)

    last = state(now)
    while last[0]:
        now = settled(_small_star(_large_star(now)))
        here = state(now)
        if here == last:
            break
        last = here
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
