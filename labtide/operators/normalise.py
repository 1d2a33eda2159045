"""Codes and units: from stored observations to readings in canonical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions import profiles
from labtide.functions.text import stripped

SERIES = ["patient_id", "code"]


def unit_key(unit: Column) -> Column:
    """Spelling-insensitive unit: trimmed, lower case, no spaces, both micro signs as ``u``."""
    return F.translate(F.replace(F.lower(stripped(unit)), F.lit(" "), F.lit("")), "µμ", "uu")


def with_analyte(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``analyte``: the short code behind a short code (any case) or LOINC code, else null."""
    codes = profiles.analyte_codes(df.sparkSession)
    return (
        df.withColumn("lookup_key", F.upper(stripped(F.col(code))))
        .join(F.broadcast(codes), "lookup_key", "left")
        .drop("lookup_key")
    )


def canonical_codes(observations: DataFrame) -> DataFrame:
    """Upload form of the code: trimmed, upper case, mapped to the profile's short code when there is one."""
    return (
        with_analyte(observations)
        .withColumn("code", F.coalesce("analyte", F.upper(stripped("code"))))
        .drop("analyte")
    )


def with_canonical_value(df: DataFrame) -> DataFrame:
    """Add ``v`` (canonical unit, null if the unit is unknown); needs ``analyte``, ``value`` and ``unit``."""
    units = profiles.unit_conversions(df.sparkSession)
    return (
        df.withColumn("unit_key", unit_key(F.col("unit")))
        .join(F.broadcast(units), ["analyte", "unit_key"], "left")
        .withColumn("v", F.col("value") * F.col("factor") + F.col("offset"))
        .drop("unit_key", "factor", "offset")
    )


def finite(value: str = "value") -> Column:
    """False or null for null, NaN (which sorts above infinity) and infinite values."""
    return F.abs(value) < float("inf")


def readings(observations: DataFrame) -> DataFrame:
    """Finite readings as (patient_id, code, analyte, t, v, u).

    ``v`` is in the canonical unit, null for a unit the profile cannot convert.
    Unprofiled codes keep the raw value and carry their unit in ``u``, because
    their unit is only known once the latest reading of the series is.
    """
    rows = with_canonical_value(with_analyte(observations.where(finite())))
    unprofiled = F.col("analyte").isNull()
    return rows.select(
        *SERIES,
        "analyte",
        F.floor(F.unix_micros("taken_at") / 1_000_000).alias("t"),
        F.when(unprofiled, F.col("value")).otherwise(F.col("v")).alias("v"),
        F.when(unprofiled, F.col("unit")).alias("u"),
    )
