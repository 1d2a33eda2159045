"""Quality rules that drop implausible series and repeated results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.operators.layout import Layout
from labtide.operators.normalise import SERIES
from labtide.operators.segments import weighted_median

# Plausible bounds per analyte.
BOUNDS = {"HBA1C": (4.0, 15.0), "LDL": (20.0, 400.0), "CREAT": (0.3, 15.0), "TSH": (0.01, 100.0)}
MIN_RESULTS = 4
MIN_DISTINCT = 3
MAX_CREAT_RATIO = 3.0


def dedupe(rows: DataFrame) -> DataFrame:
    """One result per (patient, analyte, t): the smallest value, then code; combined before the shuffle."""
    return (
        rows.groupBy("patient_id", "analyte", "t")
        .agg(F.min(F.struct("v", "code")).alias("first"))
        .select("patient_id", "analyte", "t", "first.v", "first.code")
    )


def exact_median(rows: DataFrame, keys: list[str], value: str, plan: Layout = Layout()) -> DataFrame:
    """Median per key, from counts of equal values. A key too long for one buffer of distinct
    values goes through segments instead."""
    counts = rows.groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    if plan.long_keys is not None:
        return weighted_median(counts, keys, "x", counts.count(), plan.segment_rows)
    return counts.groupBy(*keys).agg(F.expr("percentile(x, 0.5D, c)").alias("median"))


def plausibility(points: DataFrame, plan: Layout = Layout()) -> DataFrame:
    """First rule each series breaks, null when it is plausible.

    ``points`` hold deduplicated (patient_id, code, v) in canonical units, with the
    reported eGFR results of a patient under code EGFR.
    """
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for code, (lo, hi) in BOUNDS.items():
        low = F.when(F.col("code") == code, lo).otherwise(low)
        high = F.when(F.col("code") == code, hi).otherwise(high)
    measured = points.where(F.col("code").isin(*BOUNDS))
    shape = (
        measured.groupBy(*SERIES, F.round("v", 3).alias("x"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .groupBy(*SERIES)
        .agg(F.sum("c").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("distinct"))
    )
    kidney = points.where(F.col("code").isin("CREAT", "EGFR"))
    medians = (
        exact_median(kidney, SERIES, "v", plan)
        .groupBy("patient_id")
        .agg(
            F.max(F.when(F.col("code") == "CREAT", F.col("median"))).alias("creat_median"),
            F.max(F.when(F.col("code") == "EGFR", F.col("median"))).alias("egfr_median"),
        )
    )
    is_creat = F.col("code") == "CREAT"
    bounds = F.concat(F.lit("value outside "), low.cast("string"), F.lit("-"), high.cast("string"))
    reason = (
        F.when(F.col("n") < MIN_RESULTS, f"fewer than {MIN_RESULTS} results")
        .when((F.col("lo") < low) | (F.col("hi") > high), bounds)
        .when(F.col("distinct") < MIN_DISTINCT, f"fewer than {MIN_DISTINCT} distinct values")
        .when(is_creat & (F.col("hi") / F.col("lo") > MAX_CREAT_RATIO), "creatinine range > 3x")
        .when(
            is_creat & (F.col("egfr_median") >= 60) & (F.col("creat_median") > 1.5),
            "creatinine inconsistent with eGFR",
        )
    )
    return shape.join(medians, "patient_id", "left").select(*SERIES, "n", reason.alias("reason"))
