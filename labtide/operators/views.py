"""Read views over stored tables: one patient, one series, the cohort list; and the report sink.

The patient and code filters are plain predicates on the stored columns, so they
reach the parquet scan before anything is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.functions.profiles import EGFR_METHOD
from labtide.functions.text import iso_instant
from labtide.operators import layout, points, reports, review, signals, tables, triage
from labtide.options import Options


def as_recorded(observations: DataFrame) -> DataFrame:
    """Stored results in their own unit, oldest first, times as RFC 3339 UTC."""
    t = F.floor(F.unix_micros("taken_at") / 1_000_000)
    return observations.select("patient_id", "code", iso_instant(t).alias("taken_at"), "value", "unit", "source")


def cohort(observations: DataFrame, demographics: DataFrame, events: DataFrame, options: Options = Options()) -> DataFrame:
    """Listing and triage of every patient, worst first."""
    computed = reports.reports(observations, demographics, options)
    listing = tables.patient_listing(observations)
    return triage.ranked(listing.join(triage.triage(computed, events), "patient_id"))


def patient(observations: DataFrame, demographics: DataFrame, events: DataFrame, patient_id: str,
            options: Options = Options()) -> dict[str, DataFrame]:
    """Reports, review states and derivations of one patient."""
    mine = lambda df: df.where(F.col("patient_id") == patient_id)
    computed = reports.reports(mine(observations), mine(demographics), options)
    return {
        "reports": reports.nested(computed),
        "reviews": review.signal_reviews(signals.explode_signals(computed), mine(events)),
        "derived": derivations(computed, mine(demographics)),
        "demographics": mine(demographics),
    }


def series(observations: DataFrame, demographics: DataFrame, events: DataFrame, patient_id: str, code: str,
           options: Options = Options()) -> dict[str, DataFrame]:
    """One series with its report, reviews and history. ``EGFR`` is always the derived series,
    and its observations are the creatinine inputs."""
    code = code.upper()
    derived = code == "EGFR"
    mine = lambda df: df.where(F.col("patient_id") == patient_id)
    inputs = mine(observations).where(F.col("code") == ("CREAT" if derived else code))
    computed = reports.reports(inputs, mine(demographics), options).where(F.col("derived") == derived)
    logged = mine(events).where(F.col("code") == code)
    return {
        "observations": as_recorded(inputs).orderBy("taken_at"),
        "report": reports.nested(computed),
        "points": reports.all_points(inputs, mine(demographics), options).where(F.col("derived") == derived),
        "reviews": review.signal_reviews(signals.explode_signals(computed), logged).orderBy("position"),
        "history": review.history(logged, patient_id, code),
        "derived": derivations(computed, mine(demographics)),
    }


def derivations(computed: DataFrame, demographics: DataFrame) -> DataFrame:
    """How each derived series was computed."""
    return (
        computed.where("derived")
        .select("patient_id", "code")
        .join(demographics, "patient_id")
        .select("patient_id", "code", F.lit("CREAT").alias("from"), F.lit(EGFR_METHOD).alias("method"), "gender", "birth_year")
    )


def as_json(nested: DataFrame) -> DataFrame:
    """One JSON document per report."""
    keys = ["patient_id", "code", "derived"]
    body = F.to_json(F.struct(*[c for c in nested.columns if c != "patient_id"]), {"ignoreNullFields": "false"})
    return nested.select(*keys, body.alias("report"))


def write_reports(computed: DataFrame, path: str) -> None:
    """Nested reports as parquet, one folder per code."""
    reports.nested(computed).hint("rebalance", "code").write.mode("overwrite").partitionBy("code").parquet(path)


def write_series(
    observations: DataFrame, demographics: DataFrame, path: str, options: Options = Options(), plan: layout.Layout | None = None
) -> None:
    """Reports, all analysed points and RCV jumps, a table each under ``path``."""
    plan = (plan,) if plan else ()
    write_reports(reports.reports(observations, demographics, options, *plan), f"{path}/reports")
    every = reports.all_points(observations, demographics, options, *plan)
    every.hint("rebalance", "code").write.mode("overwrite").partitionBy("code").parquet(f"{path}/points")
    points.jumps(every).hint("rebalance").write.mode("overwrite").parquet(f"{path}/jumps")
