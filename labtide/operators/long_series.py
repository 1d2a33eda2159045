"""The same detector facts for series too long for one row.

Steps that need the order of a series run inside its segments, and one row per
segment carries what the next segment needs. Everything else is an aggregate
that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.functions.stats import BASELINE_MAX, CUSUM_H, CUSUM_K, EWMA_LAMBDA, clip_z
from labtide.operators import detectors, series as short
from labtide.operators.layout import Layout
from labtide.operators.long_trend import KEYS, long_trend
from labtide.operators.segments import (
    across, earlier, in_segment, running, segment_order, segmented, whole,
)
from labtide.options import Options
from labtide.session import checkpointed


class LongSeries:
    """Readings, indexed points and per-series rows of the long series of one analysis."""

    def __init__(self, readings: DataFrame, demographics: DataFrame | None, plan: Layout, options: Options) -> None:
        self.plan, self.options = plan, options
        # a creatinine series adds at most as many derived rows
        self.rows = 2 * plan.long_rows
        self.readings = plan.long(readings).withColumn("derived", F.lit(False))
        self.notes = None
        if demographics is not None:
            self._derive(demographics)
        self.shape = self._shape()
        self.points = self._indexed()

    def _small(self, df: DataFrame) -> DataFrame:
        """One row per long series: broadcast only when their number was measured to be small."""
        return F.broadcast(df) if self.plan.broadcastable else df

    def _derive(self, demographics: DataFrame) -> None:
        """Union the eGFR readings of long creatinine series; keep why others have none."""
        creat = self.readings.where("code = 'CREAT'")
        people = creat.select("patient_id").distinct().join(demographics, "patient_id", "left")
        value = short.egfr_value(F.col("t"), F.col("v"), F.col("gender"), F.col("birth_year"))
        egfr = (
            creat.join(self._small(people), "patient_id")
            .withColumn("v", value)
            .where("v IS NOT NULL")
            .select("patient_id", F.lit("EGFR").alias("code"), F.lit("EGFR").alias("analyte"), "t", "v",
                    F.lit(None).cast("string").alias("u"), F.lit(True).alias("derived"))
        )
        found = egfr.select("patient_id", F.lit(True).alias("found")).distinct()
        reason = short.egfr_reason(F.col("gender"), F.col("birth_year"), F.coalesce("found", F.lit(False)))
        self.notes = people.join(found, "patient_id", "left").select(
            "patient_id", F.lit("CREAT").alias("code"), F.lit(False).alias("derived"),
            F.coalesce(reason, F.lit("derived")).alias("creat_note"),
        )
        self.readings = self.readings.unionByName(egfr)

    def _shape(self) -> DataFrame:
        """As-of instant, exclusion counts and the unit of each series."""
        limit = self.options.as_of
        kept = F.lit(True) if limit is None else F.col("t") <= limit
        shape = self.readings.groupBy(*KEYS).agg(
            F.max("analyte").alias("analyte"),
            (F.max("t") if limit is None else F.lit(limit).cast("long")).alias("as_of"),
            F.count_if(~kept).cast("int").alias("after_as_of"),
            F.count_if(kept).alias("in_range"),
            F.max_by(F.when(kept, F.col("u")), F.when(kept, F.struct("t", "v", "u"))).alias("last_unit"),
        )
        if self.notes is None:
            return checkpointed(shape.withColumn("creat_note", F.lit(None).cast("string")))
        return checkpointed(shape.join(self.notes, KEYS, "left"))

    def _indexed(self) -> DataFrame:
        """Points with ``idx``, ``n`` and the result before each, in checkpointed segments."""
        wanted = self._small(self.shape.select(*KEYS, "as_of", "last_unit"))
        usable = self.readings.join(wanted, KEYS).where(
            (F.col("t") <= F.col("as_of")) & F.col("v").isNotNull()
            & (F.col("u").isNull() | (F.col("u") == F.col("last_unit")))
        )
        order = ["t", "v"]
        rows = segmented(usable.select(*KEYS, *order), KEYS, order, self.rows, self.plan.segment_rows)
        by_segment = rows.groupBy(*KEYS, "seg").agg(
            F.count(F.lit(1)).alias("m"),
            F.max(F.struct("t", "v")).alias("last"),
            F.max(F.col("v") <= 0).alias("bad"),
        )
        carry = by_segment.select(
            *KEYS,
            "seg",
            F.coalesce(F.sum("m").over(earlier(KEYS)), F.lit(0)).alias("offset"),
            F.sum("m").over(whole(KEYS)).alias("n"),
            F.max("bad").over(whole(KEYS)).alias("non_positive"),
            F.lag("last").over(across(KEYS)).alias("carried"),
        )
        local = in_segment(KEYS, order)
        before = F.coalesce(F.lag(F.struct("t", "v")).over(segment_order(KEYS, order)), F.col("carried"))
        joined = rows.join(carry, [*KEYS, "seg"])
        return checkpointed(
            joined.select(
                *KEYS, "seg", "t", "v", "n", "non_positive",
                (F.col("offset") + F.count(F.lit(1)).over(local) - 1).alias("idx"),
                before.alias("previous"),
            ).select(
                *KEYS, "seg", "t", "v", "n", "non_positive", "idx",
                F.col("previous.t").alias("previous_t"), F.col("previous.v").alias("previous_v"),
            )
        )

    def point_rows(self) -> DataFrame:
        """Every point of the long series, with its index and the result before it."""
        return self.points.select(*KEYS, F.col("idx").cast("int").alias("idx"), "t", "v", "previous_t", "previous_v")

    def facts(self) -> DataFrame:
        """The columns ``reports.short_facts`` gives, one row per long series."""
        base = checkpointed(self.baselines())
        charted = base.join(self._change_points(base), KEYS, "left").join(self._ewma(base), KEYS, "left")
        trended = long_trend(
            self.points, self.shape, self.options.window_days, self.rows, self.plan.broadcastable,
            self.plan.segment_rows, self.plan.block_rows,
        )
        return charted.join(trended, KEYS, "left").withColumn("trend_n", F.coalesce("trend_n", F.lit(0)))

    def baselines(self) -> DataFrame:
        """Ends, unit and personal baseline of each series, from its first and last results."""
        ends = self.points.where((F.col("idx") <= BASELINE_MAX) | (F.col("idx") >= F.col("n") - detectors.RECENT))
        pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("t", "v"))))
        edges = ends.groupBy(*KEYS).agg(
            F.max("n").cast("int").alias("n"),
            F.max("non_positive").alias("non_positive"),
            pick(F.col("idx") <= BASELINE_MAX).alias("head"),
            pick(F.col("idx") >= F.col("n") - detectors.RECENT).alias("recent"),
        )
        df = self.shape.join(edges, KEYS, "left")
        empty = F.array().cast("array<struct<t:bigint,v:double>>")
        df = (
            df.withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("non_positive", F.coalesce("non_positive", F.lit(False)))
            .withColumn("head", F.coalesce("head", empty))
            .withColumn("recent", F.coalesce("recent", empty))
            .withColumn("unit_unknown", (F.col("in_range") - F.col("n")).cast("int"))
        )
        df = short.with_profile(df).withColumn("unit", F.coalesce("canonical_unit", "last_unit", F.lit("")))
        return detectors.with_baseline(detectors.with_ends(df)).drop("in_range", "last_unit")

    def _standardised(self, base: DataFrame) -> DataFrame:
        wanted = base.where("base_n IS NOT NULL").select(*KEYS, "base_n", "base_mean", "sigma")
        z = (F.ln("v") - F.col("base_mean")) / F.col("sigma")
        return (
            self.points.join(self._small(wanted), KEYS)
            .where(F.col("idx") >= F.col("base_n"))
            .select(*KEYS, "seg", "idx", "t", "n", "base_n", z.alias("z"))
            .withColumn("zc", clip_z(F.col("z")))
        )

    def _ewma(self, base: DataFrame) -> DataFrame:
        """The recurrence as a weighted sum over the known distance to the end."""
        weight = EWMA_LAMBDA * F.pow(F.lit(1.0 - EWMA_LAMBDA), F.col("n") - 1 - F.col("idx"))
        return self._standardised(base).groupBy(*KEYS).agg(
            F.sum(weight * F.col("zc")).alias("ewma_robust"), F.sum(weight * F.col("z")).alias("ewma_level")
        )

    def _change_points(self, base: DataFrame) -> DataFrame:
        """First CUSUM alarm, its start, and the mean log level from there to the end.

        Inside a segment that starts at x, the sum after row i is
        max(x + s_i, h_i): s_i the running sum of steps, h_i the same chart started at 0.
        """
        local = in_segment(KEYS, ["idx"])
        rows = self._standardised(base)
        for side, sign in (("hi", 1.0), ("lo", -1.0)):
            rows = rows.withColumn(f"s_{side}", F.sum(sign * F.col("zc") - CUSUM_K).over(local))
        for side in ("hi", "lo"):
            floor = F.least(F.min(f"s_{side}").over(local), F.lit(0.0))
            rows = rows.withColumn(f"h_{side}", F.col(f"s_{side}") - floor)
        rows = checkpointed(rows)
        ends = rows.groupBy(*KEYS, "seg").agg(
            F.max_by(F.struct("s_hi", "h_hi", "s_lo", "h_lo"), "idx").alias("e")
        )
        carry = ends.select(*KEYS, "seg", "e.*")
        so_far = running(KEYS)
        for side in ("hi", "lo"):
            carry = carry.withColumn(f"sum_{side}", F.sum(f"s_{side}").over(so_far))
        for side in ("hi", "lo"):
            best = F.max(F.col(f"h_{side}") - F.col(f"sum_{side}")).over(so_far)
            carry = carry.withColumn(f"end_{side}", F.col(f"sum_{side}") + F.greatest(best, F.lit(0.0)))
        carry = carry.select(
            *KEYS, "seg",
            *[F.coalesce(F.lag(f"end_{s}").over(across(KEYS)), F.lit(0.0)).alias(f"x_{s}") for s in ("hi", "lo")],
        )
        charted = rows.join(carry, [*KEYS, "seg"])
        for side in ("hi", "lo"):
            charted = charted.withColumn(
                side, F.greatest(F.col(f"x_{side}") + F.col(f"s_{side}"), F.col(f"h_{side}"))
            ).withColumn(f"zero_{side}", F.when(F.col(side) == 0, F.col("idx")))
        for side in ("hi", "lo"):
            charted = charted.withColumn(f"last_{side}", F.max(f"zero_{side}").over(local))
        up = F.col("hi") > CUSUM_H
        fired = F.when(
            up | (F.col("lo") > CUSUM_H),
            F.struct(
                "idx", F.col("t").alias("detected_t"), up.alias("up"),
                F.when(up, F.col("last_hi")).otherwise(F.col("last_lo")).alias("zero"), "base_n",
            ),
        )
        by_segment = charted.groupBy(*KEYS, "seg").agg(
            F.min(fired).alias("first"), F.max("zero_hi").alias("zero_hi"), F.max("zero_lo").alias("zero_lo")
        )
        seen = by_segment.select(
            *KEYS, "first",
            F.max("zero_hi").over(earlier(KEYS)).alias("before_hi"),
            F.max("zero_lo").over(earlier(KEYS)).alias("before_lo"),
        )
        zero = F.coalesce("first.zero", F.when(F.col("first.up"), F.col("before_hi")).otherwise(F.col("before_lo")))
        alarms = (
            seen.where("first IS NOT NULL")
            .select(
                *KEYS, F.col("first.idx").alias("alarm"), F.col("first.detected_t").alias("cp_detected_t"),
                F.coalesce(zero + 1, F.col("first.base_n")).alias("start"),
            )
            .groupBy(*KEYS)
            .agg(F.min(F.struct("alarm", "cp_detected_t", "start")).alias("a"))
            .select(*KEYS, "a.cp_detected_t", "a.start")
        )
        since = self.points.join(self._small(alarms), KEYS).where(F.col("idx") >= F.col("start"))
        return since.groupBy(*KEYS).agg(
            F.min("t").alias("cp_t"), F.max("cp_detected_t").alias("cp_detected_t"), F.avg(F.ln("v")).alias("cp_mean_log")
        )
