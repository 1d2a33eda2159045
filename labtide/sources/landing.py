"""Mixed landing folders: pick the format per file, skip failing files, load the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtide.functions.text import stripped
from labtide.operators.barrier import settled
from labtide.schemas import OBSERVATION_COLUMNS
from labtide.session import checkpointed
from labtide.sources import bundles, csv, fhir, records


def detect_format(body: Column, content_type: Column | None = None) -> Column:
    """``fhir`` for a JSON content type or a body starting with ``{``, else ``csv``."""
    json_body = F.rlike(body, F.lit(r"(?U)^\s*\{"))
    if content_type is not None:
        lowered = F.lower(content_type)
        json_body = json_body | F.coalesce(
            lowered.startswith("application/json") | lowered.startswith("application/fhir+json"), F.lit(False)
        )
    return F.when(json_body, "fhir").otherwise("csv")


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """Detected format of every file, from its first non-blank line only."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        "value",
    )
    return (
        lines.where(stripped("value") != "")
        .groupBy("file")
        .agg(F.min_by(detect_format(F.col("value")), "at").alias("format"))
    )


def load(spark: SparkSession, folder: str, csv_files: str = "*.csv", json_files: str = "*.json", nested: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every CSV file and JSON document of a folder, by file name; ``nested`` takes the folders in it, too.

    Returns (observations with ``seq``, skipped resources, demographics, failed files).
    A CSV file with a wrong header or any bad row fails as a whole; so does a JSON
    document that is no Bundle or Observation. The other files load.
    """
    only = lambda names: spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", nested)
    only_csv = lambda: only(csv_files)
    found = records.blocks(only_csv(), folder)
    csv_rows = checkpointed(csv.checked_rows(csv.text_rows(only_csv(), folder, found)))
    wrong_header = csv.headers(found).where("NOT ok").select(
        "file", F.concat(F.lit("schema mismatch, got "), F.col("got")).alias("error")
    )
    bad_rows = (
        csv_rows.where("reject_reason IS NOT NULL")
        .groupBy(F.col("seq.file").alias("file"))
        .agg(F.min_by("reject_reason", "seq").alias("error"))
    )
    skeletons, entries = bundles.load(only(json_files), folder)
    bad_docs = checkpointed(fhir.document_errors(skeletons, entries))
    failed_csv = checkpointed(
        wrong_header.unionByName(bad_rows.join(wrong_header.select("file"), "file", "left_anti"))
    )
    accepted_csv, _ = csv.split(
        records.with_files(csv_rows.withColumn("file", F.col("seq.file")), failed_csv.select("file"), "left_anti").drop("file")
    )
    accepted_json, skipped, patients = fhir.split(settled(fhir.resources(skeletons, entries, bad_docs)))
    observations = accepted_csv.unionByName(accepted_json)
    return observations.select(*OBSERVATION_COLUMNS, "seq"), skipped, patients, failed_csv.unionByName(bad_docs)
