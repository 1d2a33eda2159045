"""Cohort triage: worst first by what still needs a clinician."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtide.operators.barrier import settled
from labtide.operators.review import fold
from labtide.operators.signals import status_name
from labtide.session import checkpointed


def triage(reports: DataFrame, events: DataFrame) -> DataFrame:
    """Per patient: worst status, series counts, open signals and the first open signal of the
    highest severity (stored codes in name order, the derived series last)."""
    rows = reports.select(
        "patient_id", "code", "derived", F.coalesce("display", "code").alias("display"), "status_rank",
        F.posexplode_outer("signals").alias("position", "s"),
    ).select(
        "patient_id", "code", "derived", "display", "status_rank", "position",
        F.col("s.rule").alias("rule"), F.col("s.t").alias("t"), F.col("s.severity").alias("severity"),
        F.col("s.sev_rank").alias("sev_rank"), F.col("s.explanation").alias("explanation"),
    )
    states = fold(events).select("patient_id", "code", "rule", F.col("signal_t").alias("t"), "state")
    joined = rows.join(states, ["patient_id", "code", "rule", "t"], "left")
    is_open = F.coalesce((F.col("sev_rank") > 0) & (F.coalesce("state", F.lit("unreviewed")) == "unreviewed"), F.lit(False))
    # each series counts once: on its first signal, or on its only row when it has none
    once = F.coalesce("position", F.lit(0)) == 0
    order = F.when(is_open, F.struct(-F.col("sev_rank"), "derived", "code", "position"))
    top = F.when(is_open, F.struct("code", "display", "rule", "severity", "sev_rank", "explanation"))
    grouped = joined.groupBy("patient_id").agg(
        F.max("status_rank").alias("status_rank"),
        F.count_if(once & (F.col("status_rank") == 2)).alias("alerts"),
        F.count_if(once & (F.col("status_rank") == 1)).alias("watches"),
        F.count_if(is_open).alias("unreviewed"),
        F.min_by(top, order).alias("top"),
    )
    return grouped.select(
        "patient_id",
        status_name(F.col("status_rank")).alias("status"),
        "status_rank",
        "alerts",
        "watches",
        "unreviewed",
        F.col("top.code").alias("top_code"),
        F.col("top.display").alias("top_display"),
        F.col("top.rule").alias("top_rule"),
        F.col("top.severity").alias("top_severity"),
        F.col("top.sev_rank").alias("top_rank"),
        F.col("top.explanation").alias("top_explanation"),
    )


def ranked(triaged: DataFrame) -> DataFrame:
    """Worst first, with the place in that order as ``rank``.

    The sort is range-partitioned, so no task sees the whole cohort. Its partitions are written once; a
    row's rank is its place in its partition plus the rows of the partitions before it. The exchange
    in front keeps the sampling of the sort from running the whole analysis a second time; it is on two
    columns, because one on the patient alone is already satisfied and would be planned away.
    """
    ordered = settled(triaged.repartition("patient_id", "status")).orderBy(
        F.desc_nulls_last("top_rank"), F.desc("unreviewed"), F.desc("status_rank"), F.desc("alerts"),
        F.desc("watches"), "patient_id",
    )
    placed = checkpointed(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    rank = F.col("place") - F.shiftleft(F.col("part").cast("long"), 33) + F.col("offset") + 1
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", rank).drop("part", "place", "offset").orderBy("rank")


def deciding_rules(reports: DataFrame) -> DataFrame:
    """First signal above info of each series: the rule behind its status."""
    first = F.get(F.filter("signals", lambda s: s.sev_rank > 0), F.lit(0))
    return reports.select("patient_id", "code", "derived", "status", first.alias("first")).select(
        "patient_id", "code", "derived", "status", F.col("first.rule").alias("rule"),
        F.col("first.severity").alias("severity"),
    )
