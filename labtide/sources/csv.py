"""CSV uploads: declared columns, header check, row checks with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from labtide.functions.text import stripped
from labtide.operators.normalise import canonical_codes
from labtide.schemas import CSV_RAGGED, OBSERVATION_COLUMNS
from labtide.session import checkpointed
from labtide.sources import records

CSV_OPTIONS = {"escape": '"', "columnNameOfCorruptRecord": "ragged"}


def parse_taken_at(raw: Column) -> Column:
    """Date, or date-time with ``T`` or a space, as UTC; null for anything else."""
    text = stripped(raw)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}:\d{1,2})?$"
    return F.when(F.rlike(text, F.lit(shape)), text.try_cast("timestamp"))


def headers(found: DataFrame) -> DataFrame:
    """First line of every file, normalised, with whether it is the declared header; ``found`` is from `records.blocks`."""
    clean = F.regexp_replace(stripped("first"), "^\ufeff", "")
    names = F.transform(F.split(clean, ","), lambda c: F.lower(stripped(c)))
    return found.where("start = 0").select(
        "file", F.array_join(names, ", ").alias("got"), F.lit(", ".join(OBSERVATION_COLUMNS)).alias("expected")
    ).withColumn("ok", F.col("got") == F.col("expected"))


def check_headers(found: DataFrame) -> None:
    """Raise on the first file (by name) whose header differs; the driver sees one row."""
    bad = headers(found).where("NOT ok").orderBy("file").first()
    if bad is not None:
        raise ValueError(f"schema mismatch in {bad['file']}: expected columns {bad['expected']}, got {bad['got']}")


def text_rows(reader: DataFrameReader, path: str | list[str], found: DataFrame) -> DataFrame:
    """All-string rows with their place: file, block and row, comparable as one struct ``seq``.

    ``ragged`` holds the raw text of a row with more or fewer fields than declared, or of one beyond any size. A quoted
    line break belongs to its field, and a large file still spreads over many tasks (`sources/records.py`).
    """
    text = F.regexp_replace("text", r"\r$", "")
    rows = records.records(reader, path, found).where("NOT (start = 0 AND row = 0)").withColumn("text", text).where(stripped("text") != "")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CSV_RAGGED)
    read = rows.withColumn("row_read", F.from_csv("text", F.lit(kinds), CSV_OPTIONS))
    return read.select(
        *[F.col("row_read")[c].alias(c) for c in OBSERVATION_COLUMNS],
        F.when(F.col("long"), F.col("text")).otherwise(F.col("row_read.ragged")).alias("ragged"),
        F.struct("file", "start", "row").alias("seq"),
    )


def checked_rows(rows: DataFrame) -> DataFrame:
    """Text rows with typed columns and ``reject_reason`` (null when the row is accepted)."""
    number = stripped("value").try_cast("double")
    taken_at = parse_taken_at(F.col("taken_at"))
    missing = lambda c: F.concat(F.lit("missing or null "), F.lit(c))
    uneven = F.col("ragged").isNotNull() if "ragged" in rows.columns else F.lit(False)
    reason = (
        F.when(uneven, f"not {len(OBSERVATION_COLUMNS)} fields")
        .when(F.col("value").isNull(), missing("value"))
        .when(number.isNull(), "value is not a number")
        .when(~(F.abs(number) < float("inf")), "non-finite value")
        .when(F.col("patient_id").isNull(), missing("patient_id"))
        .when(F.col("code").isNull(), missing("code"))
        .when(F.col("unit").isNull(), missing("unit"))
        .when(F.col("taken_at").isNull(), missing("taken_at"))
        .when(taken_at.isNull(), F.concat(F.lit("invalid taken_at: "), stripped("taken_at")))
        .when(F.col("source").isNull(), missing("source"))
    )
    extra = [c for c in rows.columns if c not in (*OBSERVATION_COLUMNS, "ragged")]
    return rows.select(
        stripped("patient_id").alias("patient_id"),
        F.upper(stripped("code")).alias("code"),
        number.alias("value"),
        stripped("unit").alias("unit"),
        taken_at.alias("taken_at"),
        stripped("source").alias("source"),
        *extra,
        reason.alias("reject_reason"),
    )


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted observations with canonical codes, and rejected rows with their reason."""
    accepted = canonical_codes(checked.where("reject_reason IS NULL").drop("reject_reason"))
    return accepted.select(*OBSERVATION_COLUMNS, "seq"), checked.where("reject_reason IS NOT NULL")


def read_csv(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of one file or a folder of files.

    ``strict`` refuses the whole upload at its first bad row, as an upload does.
    """
    found = records.blocks(spark.read, path)
    check_headers(found)
    # looked at for bad rows, for any rows, and read: the files are parsed once
    accepted, rejected = split(checkpointed(checked_rows(text_rows(spark.read, path, found))))
    if strict:
        worst = rejected.agg(F.min_by(F.struct("reject_reason", "seq"), "seq").alias("first")).first()["first"]
        if worst is None and accepted.isEmpty():
            raise ValueError(f"no rows in {path}")
        if worst is not None:
            raise ValueError(f"row {worst['seq']['row']} of {worst['seq']['file']}: {worst['reject_reason']}")
    return accepted, rejected
