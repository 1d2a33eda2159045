"""Mann-Kendall and Sen formulas shared by the array path and the segmented path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtide.functions.stats import DAYS_PER_YEAR, EPSILON, TREND_ALPHA, TREND_MIN, Z95, two_sided_p


def middle(sorted_values: Column) -> Column:
    """Median of a sorted array, null when it is empty."""
    n = F.size(sorted_values)
    upper = F.get(sorted_values, F.floor(n / 2).cast("int"))
    lower = F.get(sorted_values, F.floor(n / 2).cast("int") - 1)
    return F.when(n % 2 == 1, upper).when(n > 0, (lower + upper) / 2.0)


def tie_weight(t: Column) -> Column:
    """Contribution of a group of ``t`` equal values to the Mann-Kendall variance."""
    t = t.cast("double")
    return t * (t - 1.0) * (2.0 * t + 5.0)


def tie_term(sorted_values: Column) -> Column:
    """Sum of the tie weights, run by run over a sorted array."""
    start = F.struct(
        F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total")
    )

    def step(acc: Column, v: Column) -> Column:
        run = F.when(acc["last"] == v, acc["run"] + 1).otherwise(1)
        return F.struct(
            v.alias("last"), run.alias("run"), (acc["total"] + tie_weight(run) - tie_weight(run - 1)).alias("total")
        )

    return F.aggregate(sorted_values, start, step, lambda acc: acc["total"])


def mk_variance(n: Column, ties: Column) -> Column:
    n = n.cast("double")
    return (n * (n - 1.0) * (2.0 * n + 5.0) - ties) / 18.0


def ci_rank(n: Column, var_s: Column, side: int) -> Column:
    """One-based rank of a confidence limit among ``n`` sorted slopes (side -1 low, 1 high)."""
    c = Z95 * F.sqrt(F.greatest(var_s, F.lit(0.0)))
    raw = (n.cast("double") - c) / 2.0 if side < 0 else (n.cast("double") + c) / 2.0 + 1.0
    return F.greatest(F.least(F.round(raw), n.cast("double")), F.lit(1.0)).cast("long")


def trend_statistics() -> list[dict[str, Column]]:
    """Columns from S, its variance and the Sen slope, step by step."""
    n, s, var = F.col("trend_n").cast("double"), F.col("mk_s"), F.col("mk_var")
    z = F.when((s == 0) | (var <= 0), 0.0).otherwise((s - F.signum(s)) / F.sqrt(var))
    done = F.col("trend_done")
    yearly = F.when(F.abs("trend_median") > EPSILON, F.col("sen_slope") * DAYS_PER_YEAR / F.col("trend_median"))
    steep = F.col("mk_p") < TREND_ALPHA
    return [
        {"trend_done": F.coalesce((F.col("trend_n") >= TREND_MIN) & (F.col("sen_n") > 0), F.lit(False))},
        {
            "mk_z": F.when(done, z),
            "mk_tau": F.when(done, s / (n * (n - 1.0) / 2.0)),
            "change_per_year": F.when(done, F.coalesce(yearly, F.lit(0.0))),
        },
        {"mk_p": two_sided_p(F.col("mk_z"))},
        {
            "direction": F.when(
                done, F.when(steep & (s > 0), "rising").when(steep & (s < 0), "falling").otherwise("flat")
            )
        },
    ]
