"""The cohort analysis: every series of every patient in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.functions import profiles
from labtide.operators import detectors, layout as sizing, long_series, points, series, signals
from labtide.operators.normalise import readings as to_readings
from labtide.options import Options

BASELINE_LEVEL = 0.95  # coverage of the personal reference interval


def short_facts(readings: DataFrame, demographics: DataFrame | None, plan: sizing.Layout, options: Options) -> DataFrame:
    """Detector facts of the series that fit in one row."""
    collected = series.collect(readings, plan)
    if demographics is None:
        rows = collected.withColumn("derived", F.lit(False)).withColumn("creat_note", F.lit(None).cast("string"))
    else:
        rows = series.with_derived(collected, demographics)
    df = series.with_points(rows, options)
    df = detectors.with_ends(detectors.with_shape(df))
    df = detectors.with_control(detectors.with_baseline(df))
    return detectors.with_trend(df, options.window_days)


def facts(
    observations: DataFrame,
    demographics: DataFrame | None = None,
    options: Options = Options(),
    plan: sizing.Layout | None = None,
) -> DataFrame:
    """One row per series with every detector's numbers. Long series leave ``points`` null: their
    points stay in long form (``points.point_rows``)."""
    rows = to_readings(observations)
    plan = plan or sizing.measure(rows)
    df = short_facts(rows, demographics, plan, options)
    if plan.long_keys is not None:
        segmented = long_series.LongSeries(rows, demographics, plan, options)
        df = df.unionByName(segmented.facts(), allowMissingColumns=True)
    # the steps both paths share, on one row per series
    return detectors.with_rcv(detectors.with_control_limits(detectors.with_trend_statistics(df)))


def reports(
    observations: DataFrame,
    demographics: DataFrame | None = None,
    options: Options = Options(),
    plan: sizing.Layout | None = None,
) -> DataFrame:
    """Facts plus ranked signals, skipped rules and status."""
    computed = facts(observations, demographics, options, plan)
    return signals.with_signals(computed, options.window_days).withColumn(
        "window_days", F.lit(options.window_days)
    )


def all_points(
    observations: DataFrame,
    demographics: DataFrame | None = None,
    options: Options = Options(),
    plan: sizing.Layout | None = None,
) -> DataFrame:
    """One row per analysed point of every series, with the limits that apply to it."""
    rows = to_readings(observations)
    plan = plan or sizing.measure(rows)
    computed, long_rows = short_facts(rows, demographics, plan, options), None
    if plan.long_keys is not None:
        segmented = long_series.LongSeries(rows, demographics, plan, options)
        computed = computed.unionByName(segmented.baselines(), allowMissingColumns=True)
        long_rows = segmented.point_rows()
    return points.point_rows(detectors.with_rcv(computed), long_rows=long_rows)


def nested(reports_: DataFrame) -> DataFrame:
    """The report as one nested row per series. Its points (``all_points``) and reference change jumps
    (``points.jumps``) are tables of their own, whole and with the same key, so that no series has to fit in a row."""

    def part(present, **fields):
        return F.when(present, F.struct(*[F.col(c).alias(n) for n, c in fields.items()]))

    has = lambda c: F.col(c).isNotNull()
    fixed = {"reviewed": F.lit(profiles.REVIEWED), "level": F.lit(BASELINE_LEVEL)}
    return reports_.withColumns(fixed).select(
        "patient_id", "code", "derived", "unit", "as_of", "window_days", "n",
        part(has("analyte"), code="analyte", loinc="loinc", display="display", cvi="cvi", cva="cva",
             cvi_source="cvi_source", cva_source="cva_source", reviewed="reviewed").alias("analyte"),
        part(has("latest_t"), t="latest_t", v="latest_v").alias("latest"),
        F.struct("after_as_of", "unit_unknown").alias("excluded"),
        part(has("pop_low"), low="pop_low", high="pop_high", source="pop_source").alias("population"),
        F.array_sort("thresholds", lambda a, b: a.ord - b.ord).alias("thresholds"),
        part(has("base_n"), n="base_n", **{"from": "base_from"}, to="base_to", set_point="set_point",
             prri_low="prri_low", prri_high="prri_high", level="level").alias("baseline"),
        part(has("rcv_up"), up="rcv_up", down="rcv_down").alias("rcv"),
        part(has("ewma_value"), value="ewma_value", low="ewma_low", high="ewma_high").alias("ewma"),
        part(has("cp_t"), t="cp_t", detected_t="cp_detected_t", before="set_point", after="cp_after",
             change="cp_change").alias("change_point"),
        part(F.col("trend_done"), n="trend_n", **{"from": "trend_from"}, slope_per_day="sen_slope",
             ci_low_per_day="sen_low", ci_high_per_day="sen_high", change_per_year="change_per_year", tau="mk_tau",
             p_value="mk_p", direction="direction").alias("trend"),
        "signals", "not_assessed", "status",
    )
