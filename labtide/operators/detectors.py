"""Detectors over one series held as a time-ordered array, as native expressions.

Each function adds columns to a frame with one row per series. The segmented
path adds the same columns for series too long for an array. The expressions do
not depend on the data, so they are built once and reused.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions.stats import (
    BASELINE_MAX,
    BASELINE_MIN,
    CUSUM_H,
    CUSUM_K,
    DAY_SECONDS,
    EPSILON,
    EWMA_LAMBDA,
    TREND_MIN,
    Z95,
    clip_z,
    ewma_width,
    rcv_down,
    rcv_up,
)
from labtide.operators import trend_math

RECENT = 12


def _apply(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df


@cache
def _shape() -> list[dict[str, Column]]:
    n = F.size("points")
    return [
        {
            "n": n,
            "recent": F.slice("points", F.greatest(n - RECENT + 1, F.lit(1)), F.lit(RECENT)),
            "head": F.slice("points", 1, BASELINE_MAX + 1),
            "non_positive": F.exists("points", lambda p: p.v <= 0),
        }
    ]


def with_shape(df: DataFrame) -> DataFrame:
    """Counts and the ends of the series, all from ``points``."""
    return _apply(df, _shape())


@cache
def _ends() -> list[dict[str, Column]]:
    latest, previous = F.try_element_at("recent", F.lit(-1)), F.try_element_at("recent", F.lit(-2))
    return [
        {
            "latest_t": latest.t,
            "latest_v": latest.v,
            "previous_t": previous.t,
            "previous_v": previous.v,
            "on_log": F.col("analyte").isNotNull() & (F.col("n") > 0) & ~F.col("non_positive"),
        }
    ]


def with_ends(df: DataFrame) -> DataFrame:
    """Latest and previous result from ``recent``; ``on_log`` says the log-scale detectors apply."""
    return _apply(df, _ends())


@cache
def _baseline() -> list[dict[str, Column]]:
    n, sigma = F.col("n"), F.col("sigma")
    start = F.struct(
        F.lit(BASELINE_MIN).alias("k"),
        (F.get("logs", F.lit(0)) + F.get("logs", F.lit(1)) + F.get("logs", F.lit(2))).alias("total"),
        F.lit(True).alias("steady"),
    )

    def extend(acc: Column, x: Column) -> Column:
        spread = sigma * F.sqrt(1.0 + 1.0 / acc.k)
        inside = acc.steady & (F.abs((x - acc.total / acc.k) / spread) <= Z95)
        return F.when(
            inside, F.struct((acc.k + 1).alias("k"), (acc.total + x).alias("total"), F.lit(True).alias("steady"))
        ).otherwise(F.struct(acc.k.alias("k"), acc.total.alias("total"), F.lit(False).alias("steady")))

    later = F.slice(
        "logs",
        BASELINE_MIN + 1,
        F.greatest(F.least(F.lit(BASELINE_MAX - BASELINE_MIN), n - 1 - BASELINE_MIN), F.lit(0)),
    )
    half = Z95 * F.col("pred_sigma")
    return [
        {"logs": F.transform("head", lambda p: F.ln(p.v))},
        {"run": F.when(F.col("on_log") & (n > BASELINE_MIN), F.aggregate(later, start, extend))},
        {"base_n": F.col("run.k"), "base_mean": F.col("run.total") / F.col("run.k")},
        {
            "base_from": F.when(F.col("base_n").isNotNull(), F.get("head", F.lit(0)).t),
            "base_to": F.get("head", F.col("base_n") - 1).t,
            "pred_sigma": sigma * F.sqrt(1.0 + 1.0 / F.col("base_n")),
            "set_point": F.exp("base_mean"),
        },
        {
            "prri_low": F.exp(F.col("base_mean") - half),
            "prri_high": F.exp(F.col("base_mean") + half),
            "prri_z": (F.ln("latest_v") - F.col("base_mean")) / F.col("pred_sigma"),
        },
    ]


def with_baseline(df: DataFrame) -> DataFrame:
    """Earliest steady run of 3..10 results, the latest excluded, from the first results in ``head``."""
    return _apply(df, _baseline()).drop("logs", "run", "head")


@cache
def _control() -> list[dict[str, Column]]:
    zs = F.transform(
        F.slice("points", F.col("base_n") + 1, F.greatest(F.col("n") - F.col("base_n"), F.lit(0))),
        lambda p: (F.ln(p.v) - F.col("base_mean")) / F.col("sigma"),
    )
    zero = F.lit(0.0)
    start = F.struct(
        F.col("base_n").alias("i"),
        zero.alias("hi"),
        zero.alias("lo"),
        F.col("base_n").alias("hi_start"),
        F.col("base_n").alias("lo_start"),
        F.lit(None).cast("int").alias("alarm"),
        F.lit(None).cast("int").alias("start"),
        zero.alias("robust"),
        zero.alias("level"),
    )

    def step(acc: Column, z: Column) -> Column:
        zc = clip_z(z)
        hi = F.greatest(acc.hi + zc - CUSUM_K, zero)
        lo = F.greatest(acc.lo - zc - CUSUM_K, zero)
        after = acc.i + 1
        hi_start = F.when(hi == 0, after).otherwise(acc.hi_start)
        lo_start = F.when(lo == 0, after).otherwise(acc.lo_start)
        fires = acc.alarm.isNull() & ((hi > CUSUM_H) | (lo > CUSUM_H))
        return F.struct(
            after.alias("i"),
            hi.alias("hi"),
            lo.alias("lo"),
            hi_start.alias("hi_start"),
            lo_start.alias("lo_start"),
            F.when(fires, acc.i).otherwise(acc.alarm).alias("alarm"),
            F.when(fires, F.when(hi > CUSUM_H, hi_start).otherwise(lo_start)).otherwise(acc.start).alias("start"),
            (EWMA_LAMBDA * zc + (1.0 - EWMA_LAMBDA) * acc.robust).alias("robust"),
            (EWMA_LAMBDA * z + (1.0 - EWMA_LAMBDA) * acc.level).alias("level"),
        )

    since = F.slice("points", F.col("chart.start") + 1, F.col("n") - F.col("chart.start"))
    mean_log = F.aggregate(since, zero, lambda acc, p: acc + F.ln(p.v)) / (F.col("n") - F.col("chart.start"))
    return [
        {"chart": F.when(F.col("base_n").isNotNull(), F.aggregate(zs, start, step))},
        {
            "cp_t": F.get("points", F.col("chart.start")).t,
            "cp_detected_t": F.get("points", F.col("chart.alarm")).t,
            "cp_mean_log": F.when(F.col("chart.start").isNotNull(), mean_log),
            "ewma_robust": F.col("chart.robust"),
            "ewma_level": F.col("chart.level"),
        },
    ]


def with_control(df: DataFrame) -> DataFrame:
    """CUSUM change point and EWMA in one fold over the results after the baseline."""
    return _apply(df, _control()).drop("chart")


@cache
def _control_limits() -> list[dict[str, Column]]:
    at = lambda z: F.exp(F.col("base_mean") + z * F.col("sigma"))
    return [
        {"cp_after": F.exp("cp_mean_log"), "ewma_width": ewma_width(F.col("n") - F.col("base_n"))},
        {
            "cp_change": F.col("cp_after") / F.col("set_point") - 1.0,
            "ewma_value": at(F.col("ewma_level")),
            "ewma_low": at(-F.col("ewma_width")),
            "ewma_high": at(F.col("ewma_width")),
        },
    ]


def with_control_limits(df: DataFrame) -> DataFrame:
    """Values on the original scale, shared by both paths."""
    return _apply(df, _control_limits()).drop("cp_mean_log", "ewma_level")


@cache
def _rcv() -> list[dict[str, Column]]:
    sigma = F.when(F.col("on_log"), F.col("sigma"))
    pair = F.col("on_log") & (F.col("n") > 1)
    return [
        {
            "rcv_up": rcv_up(sigma),
            "rcv_down": rcv_down(sigma),
            "last_change": F.when(pair, F.col("latest_v") / F.col("previous_v") - 1.0),
        }
    ]


def with_rcv(df: DataFrame) -> DataFrame:
    """Reference change value and the change of the latest pair."""
    return _apply(df, _rcv())


@cache
def _trend(window_days: int) -> list[dict[str, Column]]:
    ready = F.col("trend_n") >= TREND_MIN
    day = lambda p: (p.t - F.col("trend_from")).cast("double") / F.lit(float(DAY_SECONDS))
    later = lambda i: F.slice("w", i + 2, F.col("trend_n"))

    def slopes_from(p: Column, i: Column) -> Column:
        return F.transform(
            F.filter(later(i), lambda q: q.d - p.d > EPSILON), lambda q: (q.v - p.v) / (q.d - p.d)
        )

    def signs_from(p: Column, i: Column) -> Column:
        return F.aggregate(later(i), F.lit(0.0), lambda acc, q: acc + F.signum(q.v - p.v))

    # every pair has a slope unless two results share an instant
    s = F.when(
        2 * F.size("slopes") == F.col("trend_n") * (F.col("trend_n") - 1),
        F.aggregate("slopes", F.lit(0.0), lambda acc, x: acc + F.signum(x)),
    ).otherwise(F.aggregate(F.transform("w", signs_from), F.lit(0.0), lambda acc, x: acc + x))
    rank = lambda side: trend_math.ci_rank(F.col("sen_n"), F.col("mk_var"), side).cast("int")
    return [
        {"recent_points": F.filter("points", lambda p: p.t >= F.col("as_of") - window_days * DAY_SECONDS)},
        {"trend_n": F.size("recent_points")},
        {"trend_from": F.when(ready, F.get("recent_points", F.lit(0)).t)},
        {"w": F.when(ready, F.transform("recent_points", lambda p: F.struct(day(p).alias("d"), p.v.alias("v"))))},
        {
            "sorted_values": F.sort_array(F.transform("w", lambda p: p.v)),
            "slopes": F.sort_array(F.flatten(F.transform("w", slopes_from))),
        },
        {
            "trend_median": trend_math.middle(F.col("sorted_values")),
            "mk_var": trend_math.mk_variance(F.col("trend_n"), trend_math.tie_term(F.col("sorted_values"))),
            "mk_s": s.cast("long"),
            "sen_n": F.size("slopes").cast("long"),
            "sen_slope": trend_math.middle(F.col("slopes")),
        },
        {
            "sen_low": F.try_element_at("slopes", rank(-1)),
            "sen_high": F.try_element_at("slopes", rank(1)),
        },
    ]


def with_trend(df: DataFrame, window_days: int) -> DataFrame:
    """Mann-Kendall and Sen over the lookback window of ``points``."""
    return _apply(df, _trend(window_days)).drop("recent_points", "w", "sorted_values", "slopes")


@cache
def _trend_statistics() -> list[dict[str, Column]]:
    return trend_math.trend_statistics()


def with_trend_statistics(df: DataFrame) -> DataFrame:
    """p-value, tau, yearly change and direction, shared by both paths."""
    return _apply(df, _trend_statistics())
