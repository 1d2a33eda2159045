"""Statistics as native Column expressions, plus SQL functions for SQL users."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Normal quantiles and detector constants.
Z95 = 1.959963985
Z99 = 2.575829304
BASELINE_MIN = 3
BASELINE_MAX = 10
CUSUM_K = 0.5
CUSUM_H = 5.0
EWMA_LAMBDA = 0.2
EWMA_L = 3.0
Z_CLIP = 4.0
TREND_MIN = 4
TREND_ALPHA = 0.05
DAYS_PER_YEAR = 365.25
DAY_SECONDS = 86_400
SQRT2 = 1.4142135623730951
EPSILON = 2.220446049250313e-16

# Chebyshev coefficients of the erfc approximation, lowest power first.
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function, fractional error below 1.2e-7."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2.0 - r)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / F.lit(SQRT2))


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic, clamped to 0..1."""
    return F.greatest(F.least(2.0 * (1.0 - normal_cdf(F.abs(z))), F.lit(1.0)), F.lit(0.0))


def rcv_up(sigma: Column, z: float = Z95) -> Column:
    return F.exp(F.lit(z) * F.lit(SQRT2) * sigma) - 1.0


def rcv_down(sigma: Column, z: float = Z95) -> Column:
    return F.exp(-(F.lit(z) * F.lit(SQRT2) * sigma)) - 1.0


def clip_z(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(Z_CLIP)), F.lit(-Z_CLIP))


def ewma_width(i: Column) -> Column:
    """Exact time-varying EWMA limit after ``i`` results, in units of sigma."""
    lam = EWMA_LAMBDA
    return EWMA_L * F.sqrt(F.lit(lam / (2.0 - lam)) * (1.0 - F.pow(F.lit(1.0 - lam), 2 * i)))


def ckd_epi_2021(scr: Column, age: Column, female: Column) -> Column:
    """eGFR (mL/min/1.73 m²) from serum creatinine in mg/dL."""
    # CKD-EPI 2021 constants.
    kappa = F.when(female, 0.7).otherwise(0.9)
    alpha = F.when(female, -0.241).otherwise(-0.302)
    ratio = scr / kappa
    return (
        142.0
        * F.pow(F.least(ratio, F.lit(1.0)), alpha)
        * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2))
        * F.pow(F.lit(0.9938), age.cast("double"))
        * F.when(female, 1.012).otherwise(1.0)
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions with the same definitions, for SQL users."""
    horner = "{!r}D".format(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        horner = f"({c!r}D + t * {horner})"
    for statement in (
        f"""CREATE OR REPLACE TEMPORARY FUNCTION normal_cdf(x DOUBLE) RETURNS DOUBLE RETURN
            SELECT 0.5D * if(x <= 0, r, 2D - r) FROM (
              SELECT t * exp(-(x / {SQRT2}D) * (x / {SQRT2}D) + {horner}) AS r FROM (
                SELECT 1D / (1D + 0.5D * abs(x / {SQRT2}D)) AS t))""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION rcv_up(cvi DOUBLE, cva DOUBLE) RETURNS DOUBLE RETURN
            exp({Z95}D * {SQRT2}D * sqrt(ln(1 + cvi * cvi) + ln(1 + cva * cva))) - 1""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION rcv_down(cvi DOUBLE, cva DOUBLE) RETURNS DOUBLE RETURN
            exp(-{Z95}D * {SQRT2}D * sqrt(ln(1 + cvi * cvi) + ln(1 + cva * cva))) - 1""",
        """CREATE OR REPLACE TEMPORARY FUNCTION ckd_epi_2021(scr DOUBLE, age DOUBLE, sex STRING) RETURNS DOUBLE RETURN
            CASE sex
              WHEN 'female' THEN 142D * pow(least(scr / 0.7D, 1D), -0.241D) * pow(greatest(scr / 0.7D, 1D), -1.2D)
                                 * pow(0.9938D, age) * 1.012D
              WHEN 'male' THEN 142D * pow(least(scr / 0.9D, 1D), -0.302D) * pow(greatest(scr / 0.9D, 1D), -1.2D)
                               * pow(0.9938D, age)
            END""",
    ):
        spark.sql(statement)
