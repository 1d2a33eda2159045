"""One row per series: collect, derive eGFR, cut at the as-of instant, fix the unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions import profiles
from labtide.functions.stats import ckd_epi_2021
from labtide.functions.text import utc_date
from labtide.operators.layout import Layout
from labtide.operators.normalise import SERIES
from labtide.options import Options

READING = "struct<t:bigint,v:double,u:string>"

# Wire names of the reasons an eGFR series cannot be derived, in order of precedence.
NO_DEMOGRAPHICS = "no_demographics"
SEX_NOT_BINARY = "sex_not_binary"
NO_ADULT_RESULTS = "no_adult_results"


def collect(readings: DataFrame, layout: Layout) -> DataFrame:
    """Time-ordered readings of every short series: one exchange, by patient unless a patient is hot."""
    rows = layout.short(readings)
    if layout.by_patient:
        rows = rows.repartition("patient_id")
    return rows.groupBy(*SERIES).agg(
        F.max("analyte").alias("analyte"),
        F.sort_array(F.collect_list(F.struct("t", "v", "u"))).alias("readings"),
    )


def egfr_value(t: Column, scr: Column, gender: Column, birth_year: Column) -> Column:
    """eGFR of one creatinine result, null when it is not an adult result in a known unit."""
    age = F.year(utc_date(t)) - birth_year
    usable = gender.isin("female", "male") & (age >= 18) & (scr > 0)
    return F.when(usable, ckd_epi_2021(scr, age, gender == "female"))


def egfr_reason(gender: Column, birth_year: Column, usable: Column) -> Column:
    """Why no eGFR series exists; null when it does."""
    return (
        F.when(birth_year.isNull(), NO_DEMOGRAPHICS)
        .when(gender.isNull() | ~gender.isin("female", "male"), SEX_NOT_BINARY)
        .when(~usable, NO_ADULT_RESULTS)
    )


def with_derived(series: DataFrame, demographics: DataFrame) -> DataFrame:
    """Measured series plus, after each creatinine series, the eGFR series derived from it.

    The derivation uses every creatinine reading; the as-of cut comes later.
    ``creat_note`` is ``derived`` or the reason there is no eGFR, on creatinine rows only.
    """
    joined = series.join(demographics, "patient_id", "left")
    gender, birth_year = F.col("gender"), F.col("birth_year")
    is_creat = F.col("code") == "CREAT"
    derived = F.when(
        is_creat & birth_year.isNotNull() & gender.isin("female", "male"),
        F.filter(
            F.transform(
                "readings",
                lambda x: F.struct(
                    x.t.alias("t"),
                    egfr_value(x.t, x.v, gender, birth_year).alias("v"),
                    F.lit(None).cast("string").alias("u"),
                ),
            ),
            lambda x: x.v.isNotNull(),
        ),
    )
    has_egfr = F.coalesce(F.size("egfr") > 0, F.lit(False))
    joined = joined.withColumn("egfr", derived).withColumn(
        "creat_note",
        F.when(is_creat, F.coalesce(egfr_reason(gender, birth_year, has_egfr), F.lit("derived"))),
    )
    measured = F.struct(
        F.col("code").alias("code"),
        F.lit(False).alias("derived"),
        F.col("analyte").alias("analyte"),
        F.col("readings").alias("readings"),
        F.col("creat_note").alias("creat_note"),
    )
    computed = F.struct(
        F.lit("EGFR").alias("code"),
        F.lit(True).alias("derived"),
        F.lit("EGFR").alias("analyte"),
        F.col("egfr").alias("readings"),
        F.lit(None).cast("string").alias("creat_note"),
    )
    return joined.select(
        "patient_id",
        F.inline(F.when(has_egfr, F.array(measured, computed)).otherwise(F.array(measured))),
    )


def with_profile(series: DataFrame) -> DataFrame:
    return series.join(F.broadcast(profiles.analytes(series.sparkSession)), "analyte", "left")


def with_points(series: DataFrame, options: Options) -> DataFrame:
    """As-of cut, unit and points; a series keeps its row even when nothing is left."""
    if options.as_of is None:
        cut = series.withColumn("as_of", F.try_element_at("readings", F.lit(-1)).t).withColumn(
            "in_range", F.col("readings")
        )
    else:
        cut = series.withColumn("as_of", F.lit(options.as_of).cast("long")).withColumn(
            "in_range", F.filter("readings", lambda x: x.t <= options.as_of)
        )
    unit = F.coalesce("canonical_unit", F.try_element_at("in_range", F.lit(-1)).u, F.lit(""))
    return (
        with_profile(cut)
        .withColumn("unit", unit)
        .withColumn(
            "points",
            F.transform(
                F.filter("in_range", lambda x: x.v.isNotNull() & (x.u.isNull() | (x.u == F.col("unit")))),
                lambda x: F.struct(x.t.alias("t"), x.v.alias("v")),
            ),
        )
        .withColumn("after_as_of", F.size("readings") - F.size("in_range"))
        .withColumn("unit_unknown", F.size("in_range") - F.size("points"))
        .drop("readings", "in_range")
    )
