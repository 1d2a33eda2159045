"""Point-level projections: every analysed result with what it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions.text import signed_pct
from labtide.operators.normalise import SERIES

CONTEXT = [
    "patient_id", "code", "derived", "on_log", "sigma", "rcv_up", "rcv_down", "prri_low", "prri_high", "thresholds"
]


def linked(points: str = "points") -> Column:
    """Array of points with their index and the result before them."""

    def link(p: Column, i: Column) -> Column:
        before = F.get(points, i - 1)
        return F.struct(
            i.alias("idx"), p.t.alias("t"), p.v.alias("v"), before.t.alias("previous_t"), before.v.alias("previous_v")
        )

    return F.transform(points, link)


def point_rows(facts: DataFrame, columns: list[str] = CONTEXT, long_rows: DataFrame | None = None) -> DataFrame:
    """One row per analysed point. ``long_rows`` adds the points of segmented series, which
    already carry the same columns; their facts join on the series key."""
    keep = [*dict.fromkeys(["patient_id", "code", "derived", *columns])]
    short = facts.select(*keep, F.inline(linked()))
    if long_rows is None:
        return short
    joined = long_rows.join(facts.select(*keep), ["patient_id", "code", "derived"])
    return short.unionByName(joined.select(*short.columns))


def jumps(rows: DataFrame) -> DataFrame:
    """Consecutive changes beyond the 95 % reference change value."""
    change = F.col("v") / F.col("previous_v") - 1.0
    return rows.where(F.col("on_log") & F.col("previous_v").isNotNull() & (change_beyond(change))).select(
        "patient_id", "code", "derived", F.col("previous_t").alias("from_t"), F.col("t").alias("to_t"),
        change.alias("change"),
    )


def change_beyond(change: Column) -> Column:
    return (change > F.col("rcv_up")) | (change < F.col("rcv_down"))


def annotations(rows: DataFrame) -> DataFrame:
    """Outside the personal interval, change beyond the RCV, deepest threshold met, and flag words."""
    pair = F.col("on_log") & F.col("previous_v").isNotNull()
    change = F.when(pair, F.col("v") / F.col("previous_v") - 1.0)
    met = F.filter(
        "thresholds",
        lambda x: F.when(x.direction == "above", F.col("v") >= x.value).otherwise(F.col("v") < x.value),
    )
    deepest = F.try_element_at(met, F.lit(-1))
    return (
        rows.withColumn(
            "outside", F.coalesce((F.col("v") < F.col("prri_low")) | (F.col("v") > F.col("prri_high")), F.lit(False))
        )
        .withColumn("jump", F.when(change_beyond(change), change))
        .withColumn("threshold_label", deepest.label)
        .withColumn("threshold_severity", deepest.severity)
        .withColumn(
            "flags",
            F.concat_ws(
                "; ",
                F.when(F.col("outside"), "outside personal range"),
                F.concat(F.lit("change beyond RCV ("), signed_pct(F.col("jump")), F.lit(")")),
                F.col("threshold_label"),
            ),
        )
        .select(
            *SERIES, "derived", "idx", "t", "v", "outside", "jump", "threshold_label", "threshold_severity", "flags"
        )
    )


def table_rows(annotated: DataFrame, observations: DataFrame) -> DataFrame:
    """Annotated points beside the result as recorded; derived points show their creatinine input."""
    recorded = observations.select(
        "patient_id",
        F.col("code").alias("input_code"),
        F.floor(F.unix_micros("taken_at") / 1_000_000).alias("t"),
        F.col("value").alias("recorded_value"),
        F.col("unit").alias("recorded_unit"),
    )
    inputs = F.when(F.col("derived"), F.lit("CREAT")).otherwise(F.col("code"))
    return annotated.withColumn("input_code", inputs).join(recorded, ["patient_id", "input_code", "t"], "left")
