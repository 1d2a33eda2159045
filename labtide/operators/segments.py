"""Order-dependent sums over keys of any size, without a window that holds a whole key.

Rows are range-partitioned by key and order, so a hot key spreads over many
partitions of similar size. The partition number becomes the segment; it is fixed
by a checkpoint, because later steps must all see the same segments. Windows run
inside a segment, and a second small window carries totals from one segment of a
key to the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtide.session import checkpointed

SEGMENT_ROWS = 200_000


def segmented(df: DataFrame, keys: list[str], order: list[str], rows: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``seg``; segments of one key follow its order. ``rows`` is a measured upper bound."""
    parts = max(1, math.ceil(rows / segment_rows))
    return checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("seg", F.spark_partition_id()))


def in_segment(keys: list[str], order: list[str]):
    return segment_order(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def segment_order(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, "seg").orderBy(*order)


def across(keys: list[str]):
    """Window over the segments of a key, for rows that hold one segment each."""
    return W.partitionBy(*keys).orderBy("seg")


def running(keys: list[str]):
    return across(keys).rowsBetween(W.unboundedPreceding, W.currentRow)


def earlier(keys: list[str]):
    return across(keys).rowsBetween(W.unboundedPreceding, -1)


def whole(keys: list[str]):
    return W.partitionBy(*keys)


def with_running(df: DataFrame, keys: list[str], order: list[str], weight: Column) -> DataFrame:
    """Add ``before`` (weight of the earlier rows of the key) and ``total`` (weight of the key)."""
    weighted = df.withColumn("weight", weight)
    sums = weighted.groupBy(*keys, "seg").agg(F.sum("weight").alias("seg_weight"))
    offsets = sums.select(
        *keys,
        "seg",
        F.coalesce(F.sum("seg_weight").over(earlier(keys)), F.lit(0)).alias("offset"),
        F.sum("seg_weight").over(whole(keys)).alias("total"),
    )
    local = F.sum("weight").over(in_segment(keys, order)) - F.col("weight")
    return (
        weighted.withColumn("local", local)
        .join(offsets, [*keys, "seg"])
        .withColumn("before", F.col("offset") + F.col("local"))
        .drop("weight", "local", "offset")
    )


def weighted_median(counts: DataFrame, keys: list[str], value: str, rows: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Exact median per key from (keys, value, c): distinct values with their counts."""
    ranked = with_running(segmented(counts, keys, [value], rows, segment_rows), keys, [value], F.col("c"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0).alias("median")
    )
