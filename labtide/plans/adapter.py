"""Driver tables as lab data: a deterministic mapping with integer and plain float steps only.

``events`` become lab results, ``customer`` becomes demographics. Literals are
doubles on purpose, so that another engine doing the same steps gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtide.session import configure

EPOCH_2024 = 1_704_067_200
EPOCH_2022 = 1_640_995_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the event id and whole-second time they came from."""
    spans = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) - {EPOCH_2024}L")
    base = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (spans * 30).alias("s"))
    day = "(CAST(s AS DOUBLE) / 86400D)"
    rows = (
        base.withColumn(
            "code",
            F.expr(
                "CASE event_type WHEN 'click' THEN 'HBA1C' WHEN 'view' THEN 'LDL' WHEN 'purchase' THEN 'TSH'"
                " WHEN 'signup' THEN 'CREAT' ELSE 'XERR' END"
            ),
        )
        .withColumn(
            "level",
            F.expr(
                "CASE code WHEN 'HBA1C' THEN 5.4D WHEN 'LDL' THEN 118D"
                " WHEN 'TSH' THEN IF(user_id % 7 = 0, 4D, 2D)"
                " WHEN 'CREAT' THEN IF(user_id % 11 = 0, 1.3D, 0.95D) ELSE 50D END"
            ),
        )
        .withColumn(
            "cv",
            F.expr(
                "CASE code WHEN 'HBA1C' THEN 0.012D WHEN 'LDL' THEN 0.078D WHEN 'TSH' THEN 0.177D"
                " WHEN 'CREAT' THEN 0.044D ELSE 0.05D END"
            ),
        )
        .withColumn(
            "m",
            F.expr(
                f"CASE user_id % 5 WHEN 0 THEN 1D WHEN 1 THEN IF({day} >= 450D, 1.3D, 1D)"
                f" WHEN 2 THEN 1D + 0.3D * {day} / 900D WHEN 3 THEN IF(event_id % 17 = 0, 1.6D, 1D)"
                f" ELSE IF({day} >= 600D, 0.7D, 1D) END"
            ),
        )
        .withColumn("noise", F.expr("CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000D - 0.5D"))
        .withColumn("cval", F.expr("level * m * (1D + 2D * cv * noise)"))
        .withColumn(
            "unit",
            F.expr(
                "CASE WHEN event_id % 97 = 0 THEN 'mg/L'"
                " WHEN code = 'CREAT' AND event_id % 4 = 0 THEN 'umol/L'"
                " WHEN code = 'HBA1C' AND event_id % 5 = 0 THEN 'mmol/mol'"
                " WHEN code = 'LDL' AND event_id % 6 = 0 THEN 'mmol/L'"
                " WHEN code = 'XERR' AND event_id % 10 = 0 THEN 'IU/L'"
                " WHEN code = 'HBA1C' THEN '%' WHEN code = 'TSH' THEN 'm[IU]/L' WHEN code = 'XERR' THEN 'U/L'"
                " ELSE 'mg/dL' END"
            ),
        )
        .withColumn(
            "value",
            F.expr(
                "(cval - IF(unit = 'mmol/mol', 2.152D, 0D))"
                " * CASE unit WHEN 'umol/L' THEN 88.42D WHEN 'mmol/mol' THEN 10.931D"
                " WHEN 'mmol/L' THEN 0.025860D ELSE 1D END"
            ),
        )
        .select(
            "event_id",
            "user_id",
            F.expr("concat('P', user_id)").alias("patient_id"),
            "code",
            "value",
            "unit",
            F.expr(f"timestamp_seconds({EPOCH_2022}L + s)").alias("taken_at"),
            F.lit("events").alias("source"),
            F.expr(f"{EPOCH_2022}L + s").alias("t"),
        )
    )
    return rows


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab_events(spark, sf_dir).select("patient_id", "code", "value", "unit", "taken_at", "source")


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.expr("concat('P', c_custkey)").alias("patient_id"),
            F.expr(
                "CASE WHEN c_custkey % 10 <= 4 THEN 'female' WHEN c_custkey % 10 = 8 THEN 'other' ELSE 'male' END"
            ).alias("gender"),
            F.expr("IF(c_custkey % 13 = 12, NULL, CAST(1940 + 3 * c_nationkey AS INT))").alias("birth_year"),
        )
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review log over the latest result of every series: one short history per rule,
    whose actions depend on user_id % 4."""
    latest = (
        lab_events(spark, sf_dir).groupBy("user_id", "patient_id", "code").agg(F.max("t").alias("signal_t"))
    )
    rules = F.array(*[F.lit(r) for r in ("prri", "rcv", "shift", "ewma", "trend", "threshold", "population")])
    actions = F.expr(
        "CASE user_id % 4 WHEN 0 THEN array('acknowledge') WHEN 1 THEN array('annotate')"
        " WHEN 2 THEN array('dismiss', 'reopen') ELSE array('dismiss', 'annotate', 'acknowledge') END"
    )
    return (
        latest.withColumn("rule", F.explode(rules))
        .select("*", F.posexplode(actions).alias("pos", "action"))
        .select(
            F.expr("CAST(pos + 1 AS BIGINT)").alias("id"),
            "patient_id",
            "code",
            "rule",
            "signal_t",
            "action",
            F.expr("IF(action = 'acknowledge', NULL, concat(action, ' after chart review'))").alias("reason"),
            F.lit("demo-clinician").alias("actor"),
            F.lit("{}").alias("snapshot"),
            F.expr("signal_t + pos + 1").alias("created_at"),
        )
    )
