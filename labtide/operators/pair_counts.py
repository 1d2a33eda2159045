"""Count ordered pairs inside a key of any size without forming the pairs.

A pair (i before j) is concordant when the later value is larger. Rows are cut into
time blocks and value blocks of bounded size; every pair then falls in one case:

* same time block: counted inside that block;
* same value block, other time block: counted inside the value block, from cells
  (time block, value, count), so that a value repeated many times is one cell;
* both blocks differ: counted from the grid of block sizes.

Each count is an inversion count in O(m log m) on one bounded group.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 100_000

# the helpers travel with the job, so executors need numpy and pandas but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rising_weight(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of w_i * w_j over i < j with values[i] < values[j].

    Works down the bits of the value ranks. Rows that agree on all higher bits form one
    group, in their original order; a rising pair is counted at the first bit that differs.
    """
    if len(values) == 0:
        return 0
    r = np.unique(values, return_inverse=True)[1]
    w, place, total = weights, np.arange(len(r)), 0
    start, end = np.zeros(len(r), dtype=np.int64), np.full(len(r), len(r), dtype=np.int64)
    for bit in reversed(range(int(r.max()).bit_length())):
        one = ((r >> bit) & 1).astype(bool)
        weight = np.r_[0, np.cumsum(np.where(one, 0, w))]
        total += int(np.sum(np.where(one, w * (weight[:-1] - weight[start]), 0)))
        # stable split of every group into its zeros, then its ones
        zeros = np.r_[0, np.cumsum(~one)]
        middle = start + zeros[end] - zeros[start]
        seen = zeros[:-1] - zeros[start]
        to = np.where(one, middle + (place - start - seen), start + seen)
        moved = np.empty((4, len(r)), dtype=np.int64)
        moved[:, to] = r, w, np.where(one, middle, start), np.where(one, end, middle)
        r, w, start, end = moved
    return total


def strict_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, falling: bool = True) -> tuple[int, int]:
    """Weighted pairs with a smaller ``a`` first: (larger ``b`` later, smaller ``b`` later)."""
    up = np.lexsort((-b, a))
    rising = rising_weight(b[up], c[up])
    if not falling:
        return rising, 0
    down = np.lexsort((b, a))
    return rising, rising_weight(-b[down], c[down])


def slopes_at_ranks(x: np.ndarray, y: np.ndarray, ranks: list[int]) -> list[float]:
    """Order statistics of the pairwise slopes (one-based ranks, pairs with equal x have none).

    The number of slopes not above s is the number of pairs whose y - s*x does not rise, so each
    rank is found by bisection over the doubles, without listing the slopes.
    """
    order = np.lexsort((y, x))
    x, y, ones = x[order], y[order], np.ones(len(x), dtype=np.int64)
    _, same = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    comparable = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum())
    gap = np.diff(x)
    steepest = (y.max() - y.min()) / gap[gap > 0].min()

    def bits(v: float) -> int:
        b = int(np.float64(abs(v)).view(np.int64))
        return b if v >= 0 else -b

    def number(b: int) -> float:
        return float(np.copysign(np.int64(abs(b)).view(np.float64), b))

    found, low = {}, bits(-steepest * 1.001) - 1
    for rank in sorted(set(ranks)):
        lo, hi = low, bits(steepest * 1.001) + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            reached = comparable - rising_weight(y - number(mid) * x, ones) >= rank
            lo, hi = (lo, mid) if reached else (mid, hi)
        found[rank], low = number(hi), lo
    return [found[rank] for rank in ranks]


def _counter(keys: list[str], falling: bool):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ones = np.ones(len(pdf), dtype=np.int64)
        up, down = strict_pairs(pdf["pos"].to_numpy(), pdf["w"].to_numpy(), ones, falling)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "rising": up, "falling": down}])

    return count


def _result_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("rising", T.LongType()), T.StructField("falling", T.LongType())]
    )


def pair_counts(df: DataFrame, keys: list[str], longest: int, rows: int, block_rows: int = BLOCK_ROWS,
                falling: bool = True) -> DataFrame:
    """Per key, pairs that rise and fall over time, from columns ``pos`` (0-based, unique) and ``w``.

    ``longest`` is the measured size of the largest key and ``rows`` of all rows. Without
    ``falling`` only the rising pairs are counted.
    """
    schema = _result_schema(df, keys)
    blocked = df.withColumn("tb", F.floor(F.col("pos") / block_rows))
    counts = blocked.groupBy(*keys, "tb").applyInPandas(_counter(keys, falling), schema)
    if longest > block_rows:
        cells = blocked.groupBy(*keys, "tb", "w").agg(F.count(F.lit(1)).alias("c"))
        parts = max(2, math.ceil(rows / block_rows))
        valued = cells.repartitionByRange(parts, *keys, "w")
        grid_schema = T.StructType(
            [
                *[df.schema[k] for k in keys],
                *[T.StructField(n, T.LongType()) for n in ("tb", "vb", "c", "rising", "falling")],
            ]
        )
        grid = valued.withColumn("vb", F.spark_partition_id().cast("long")).mapInPandas(
            _value_block(keys, falling), grid_schema
        )
        counts = counts.unionByName(grid.groupBy(*keys).applyInPandas(_grid(keys, falling), schema))
    return counts.groupBy(*keys).agg(F.sum("rising").alias("rising"), F.sum("falling").alias("falling"))


def _value_block(keys: list[str], falling: bool):
    def blocks(batches):
        # one partition is one value block (per key), of bounded size
        parts = [pdf for pdf in batches if len(pdf)]
        if not parts:
            return
        for key, pdf in pd.concat(parts).groupby(keys, sort=False, dropna=False):
            counted = strict_pairs(
                pdf["tb"].to_numpy(), pdf["w"].to_numpy(), pdf["c"].to_numpy(np.int64), falling
            )
            sizes = pdf.groupby("tb", as_index=False).agg(c=("c", "sum"), vb=("vb", "first"))
            for name, value in zip(keys, key):
                sizes[name] = value
            sizes["rising"], sizes["falling"] = 0, 0
            sizes.loc[sizes.index[0], ["rising", "falling"]] = counted
            yield sizes[[*keys, "tb", "vb", "c", "rising", "falling"]]

    return blocks


def _grid(keys: list[str], falling: bool):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        up, down = strict_pairs(
            pdf["tb"].to_numpy(), pdf["vb"].to_numpy(), pdf["c"].to_numpy(np.int64), falling
        )
        row = {k: pdf[k].iloc[0] for k in keys}
        row["rising"] = up + int(pdf["rising"].sum())
        row["falling"] = down + int(pdf["falling"].sum())
        return pd.DataFrame([row])

    return count
