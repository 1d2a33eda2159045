"""Mann-Kendall and Sen for windows too long for one row.

S is a count of rising and falling pairs. The number of pairwise slopes not above a
candidate s is again a pair count, of y - s*x, so each wanted order statistic is
found by a search over candidate slopes. A window of at most one block is searched
inside one task. A longer one is counted by ``pair_counts`` over many tasks: every
round of candidates is one Spark job, with four small rows per series between rounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtide.functions.stats import DAY_SECONDS, TREND_MIN
from labtide.operators import trend_math
from labtide.operators.pair_counts import BLOCK_ROWS, pair_counts, rising_weight, slopes_at_ranks
from labtide.operators.segments import SEGMENT_ROWS, segmented, weighted_median, with_running
from labtide.session import checkpointed

KEYS = ["patient_id", "code", "derived"]
FANOUT = 8

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def long_trend(indexed: DataFrame, series: DataFrame, window_days: int, rows: int, small_keys: bool,
               segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trend columns per series (KEYS) of ``indexed`` points (KEYS, t, v) and ``series`` (KEYS, as_of)."""
    hint = F.broadcast if small_keys else (lambda df: df)
    window = indexed.select(*KEYS, "t", "v").join(hint(series.select(*KEYS, "as_of")), KEYS).where(
        F.col("t") >= F.col("as_of") - window_days * DAY_SECONDS
    ).drop("as_of")
    counts = window.groupBy(*KEYS, "v").agg(F.count(F.lit(1)).alias("c"))
    ties = counts.groupBy(*KEYS).agg(F.sum(trend_math.tie_weight(F.col("c"))).alias("ties"))
    same_t = window.groupBy(*KEYS, "t").agg(F.count(F.lit(1)).alias("c"))
    same_tv = window.groupBy(*KEYS, "t", "v").agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda df, name: df.where("c > 1").groupBy(*KEYS).agg(
        F.sum(F.expr("c * (c - 1) div 2")).alias(name)
    )
    shape = (
        window.groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("trend_n"), F.min("t").alias("trend_from"),
            F.min("v").alias("low"), F.max("v").alias("high"),
        )
        .join(ties, KEYS)
        .join(pairs(same_t, "same_t"), KEYS, "left")
        .join(pairs(same_tv, "same_tv"), KEYS, "left")
        .join(weighted_median(counts, KEYS, "v", rows, segment_rows).withColumnRenamed("median", "trend_median"), KEYS)
        .na.fill(0, ["same_t", "same_tv"])
        .withColumn("mk_var", trend_math.mk_variance(F.col("trend_n"), F.col("ties")))
        .withColumn("all_pairs", F.expr("trend_n * (trend_n - 1) div 2"))
        .withColumn("sen_n", F.col("all_pairs") - F.col("same_t"))
    )
    shape = checkpointed(shape)
    longest = shape.agg(F.max("trend_n")).first()[0] or 0

    ready = shape.where(F.col("trend_n") >= TREND_MIN)
    fits = F.col("trend_n") <= block_rows
    statistics = _one_task(window, ready.where(fits), hint)
    if longest > block_rows:
        statistics = statistics.unionByName(
            _many_tasks(window, ready.where(~fits), hint, longest, rows, segment_rows, block_rows)
        )
    out = shape.join(statistics, KEYS, "left")
    blank = lambda c: F.when(F.col("trend_n") >= TREND_MIN, F.col(c)).alias(c)
    return out.select(
        *KEYS, F.col("trend_n").cast("int").alias("trend_n"),
        *[blank(c) for c in ("trend_from", "trend_median", "mk_var", "mk_s", "sen_n", "sen_slope", "sen_low", "sen_high")],
    )


def _ranks() -> Column:
    """One-based ranks of the two middle slopes and of the confidence limits."""
    n = F.col("sen_n")
    return F.array(
        F.floor((n + 1) / 2), F.floor(n / 2) + 1,
        trend_math.ci_rank(n, F.col("mk_var"), -1), trend_math.ci_rank(n, F.col("mk_var"), 1),
    )


STATISTICS = T.StructType(
    [
        T.StructField("patient_id", T.StringType()), T.StructField("code", T.StringType()),
        T.StructField("derived", T.BooleanType()), T.StructField("mk_s", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("sen_slope", "sen_low", "sen_high")],
    ]
)


def _one_task(window: DataFrame, shape: DataFrame, hint) -> DataFrame:
    """Windows of at most one block: each is one bounded group."""

    def statistics(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "v"], kind="stable")
        x = (pdf["t"] - pdf["t"].iloc[0]).to_numpy(np.float64) / DAY_SECONDS
        y = pdf["v"].to_numpy(np.float64)
        ones = np.ones(len(y), dtype=np.int64)
        s = rising_weight(y, ones) - rising_weight(-y, ones)
        slopes = [None] * 4
        if x[-1] > 0:
            slopes = slopes_at_ranks(x, y, [int(r) for r in pdf["ranks"].iloc[0]])
        middle = None if slopes[0] is None else (slopes[0] + slopes[1]) / 2.0
        return pd.DataFrame(
            [[*pdf[KEYS].iloc[0], s, middle, slopes[2], slopes[3]]], columns=STATISTICS.names
        )

    rows = window.join(hint(shape.select(*KEYS, _ranks().alias("ranks"))), KEYS)
    return rows.groupBy(*KEYS).applyInPandas(statistics, STATISTICS)


def _many_tasks(window: DataFrame, shape: DataFrame, hint, longest: int, rows: int, segment_rows: int,
                block_rows: int) -> DataFrame:
    """Windows of several blocks: pair counts over blocks, slopes by rounds of candidates."""
    ordered = with_running(
        segmented(window.join(hint(shape.select(*KEYS, "trend_from")), KEYS), KEYS, ["t", "v"], rows, segment_rows),
        KEYS, ["t", "v"], F.lit(1),
    )
    points = checkpointed(
        ordered.select(
            *KEYS,
            F.col("before").alias("pos"),
            ((F.col("t") - F.col("trend_from")).cast("double") / float(DAY_SECONDS)).alias("x"),
            F.col("v").alias("y"),
        )
    )
    s = pair_counts(points.withColumnRenamed("y", "w"), KEYS, longest, rows, block_rows).select(
        *KEYS, (F.col("rising") - F.col("falling")).alias("mk_s")
    )
    return s.join(_order_statistics(points, shape, longest, rows, block_rows), KEYS, "left").select(*STATISTICS.names)


def _order_statistics(points: DataFrame, shape: DataFrame, longest: int, rows: int, block_rows: int) -> DataFrame:
    """Median slope and confidence limits: the smallest s whose slope count reaches each rank."""
    # two results of a series are at least a second apart, or share an instant and have no slope
    steepest = (F.col("high") - F.col("low")) * float(DAY_SECONDS) * 1.000001 + 1e-300
    state = shape.where("sen_n > 0").select(
        *KEYS,
        (F.col("all_pairs") - F.col("same_tv")).alias("base"),
        F.posexplode(_ranks()).alias("target", "rank"),
        (-steepest).alias("lo"),
        steepest.alias("hi"),
    )
    state = checkpointed(state)
    while not (open_ := state.where(~_settled())).isEmpty():
        tried = checkpointed(open_.select("*", F.explode(_candidates()).alias("s")))
        # no broadcast hint: adaptive execution sees the sizes and splits a hot key
        moved = points.join(tried.select(*KEYS, "s").distinct(), KEYS).select(
            *KEYS, "s", "pos", (F.col("y") - F.col("s") * F.col("x")).alias("w")
        )
        counted = pair_counts(moved, [*KEYS, "s"], longest, rows * 2 * FANOUT, block_rows, falling=False)
        reached = F.col("base") - F.col("rising") >= F.col("rank")
        narrowed = (
            tried.join(counted, [*KEYS, "s"])
            .groupBy(*KEYS, "target")
            .agg(
                F.first("base").alias("base"),
                F.first("rank").alias("rank"),
                F.coalesce(F.max(F.when(~reached, F.col("s"))), F.first("lo")).alias("lo"),
                F.coalesce(F.min(F.when(reached, F.col("s"))), F.first("hi")).alias("hi"),
            )
        )
        state = checkpointed(narrowed.unionByName(state.where(_settled())))
    at = lambda i: F.max(F.when(F.col("target") == i, (F.col("lo") + F.col("hi")) / 2.0))
    return state.groupBy(*KEYS).agg(
        ((at(0) + at(1)) / 2.0).alias("sen_slope"), at(2).alias("sen_low"), at(3).alias("sen_high")
    )


def _settled() -> Column:
    """The bracket is as narrow as the arithmetic of y - s*x can tell apart."""
    return F.col("hi") - F.col("lo") <= F.greatest(F.abs("lo"), F.abs("hi")) * 1e-12 + 1e-18


def _candidates() -> Column:
    """Candidate slopes strictly inside the bracket: geometric once both ends share a sign and
    differ by much, else evenly spaced, with zero tried first when the signs differ."""
    lo, hi = F.col("lo"), F.col("hi")
    steps = F.sequence(F.lit(1), F.lit(FANOUT - 1))
    even = F.transform(steps, lambda i: lo + (hi - lo) * (i / float(FANOUT)))
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    floor = F.greatest(small, large * 1e-15, F.lit(1e-18))
    sign = F.when(hi <= 0, -1.0).otherwise(1.0)
    spread = F.transform(steps, lambda i: sign * floor * F.pow(large / floor, i / float(FANOUT)))
    across_zero = F.array(F.lit(-1e-18), F.lit(0.0), F.lit(1e-18))
    picked = F.when((lo < 0) & (hi > 0), F.concat(even, across_zero)).when(large > 4 * small, spread).otherwise(even)
    return F.array_distinct(F.filter(picked, lambda s: (s > lo) & (s < hi)))
