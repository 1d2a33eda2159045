"""Incremental uploads as Structured Streaming: no repeats, no lateness limit, touched series only.

Every micro-batch is idempotent, so a replayed batch (lost executor, restart) leaves the
tables as they were: results are inserted by key, every table commits a feed's batch number with its rows and
leaves a known one out, and touched series are taken from the batch itself. Only the buckets of touched patients
are read for a refresh. Refreshes carry a version; readers take the latest one per series, and
older ones go when a table's generations are merged (`operators/ledger.py`).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labtide.operators import reports, signals, tables
from labtide.operators.ledger import Ledger
from labtide.operators.normalise import SERIES
from labtide.options import Options
from labtide.session import checkpointed
from labtide.sources import csv, fhir, records

#: Files of one micro-batch, whose names pass the driver.
FILES = 1000


@dataclass(frozen=True)
class Store:
    """Folders of the stored tables, on storage every executor reaches."""

    root: str

    @property
    def results(self) -> str:
        return f"{self.root}/results"

    @property
    def demographics(self) -> str:
        return f"{self.root}/demographics_log"

    @property
    def signals(self) -> str:
        return f"{self.root}/signals"

    @property
    def status(self) -> str:
        return f"{self.root}/status"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"


def _place() -> list:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]


def csv_uploads(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Names of the files that arrive; their content is read in blocks by each batch."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return found.option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.csv").load(folder).select("path")


def fhir_uploads(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Newline-delimited FHIR resources."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.ndjson").text(folder)
    return raw.select("value", *_place())


def run_csv(spark: SparkSession, folder: str, store: Store, checkpoint: str, options: Options = Options(), files: int = FILES) -> StreamingQuery:
    """Process every file not seen yet, then stop. A file is one upload: with other columns than declared, or
    with a bad row, none of it is stored, and its rows go to the rejects with the reason."""

    def batch(df: DataFrame, number: int) -> None:
        names = sorted(r["path"] for r in df.distinct().collect())  # the files of one micro-batch
        if not names:
            return
        found = records.blocks(spark.read, names)
        checked = checkpointed(csv.checked_rows(csv.text_rows(spark.read, names, found)))
        bad_header = csv.headers(found).where("NOT ok").select(
            "file", F.concat(F.lit("schema mismatch, got "), F.col("got")).alias("fault")
        )
        bad_row = checked.where("reject_reason IS NOT NULL").groupBy(F.col("seq.file").alias("file")).agg(
            F.min_by("reject_reason", "seq").alias("first")
        )
        bad_row = bad_row.join(bad_header.select("file"), "file", "left_anti")
        faults = checkpointed(bad_header.unionByName(bad_row.select("file", F.concat(F.lit("file refused: "), F.col("first")).alias("fault"))))
        judged = records.with_files(checked.withColumn("file", F.col("seq.file")), faults, "left").drop("file")
        reason = F.when(F.col("fault").startswith("schema"), F.col("fault")).otherwise(F.coalesce("reject_reason", "fault"))
        accepted, rejected = csv.split(judged.withColumn("reject_reason", reason).drop("fault"))
        rejected.drop("seq").write.mode("overwrite").parquet(f"{store.rejects}/feed=csv/batch={number}")
        tables.append_results(spark, store.results, accepted, feed="csv", number=number)
        refresh(spark, store, accepted.select(*SERIES).distinct(), "csv", number, options)

    return _start(csv_uploads(spark, folder, files), batch, checkpoint)


def run_fhir(spark: SparkSession, folder: str, store: Store, checkpoint: str, options: Options = Options(), files: int = FILES) -> StreamingQuery:
    """The same for FHIR resources; a Patient seen again corrects that patient's derived series."""

    def batch(df: DataFrame, number: int) -> None:
        accepted, skipped, patients = fhir.split(fhir.parsed_lines(df))
        skipped.write.mode("overwrite").parquet(f"{store.rejects}/feed=fhir/batch={number}")
        tables.append_demographics(spark, store.demographics, patients, feed="fhir", number=number)
        tables.append_results(spark, store.results, accepted, feed="fhir", number=number)
        kidney = patients.select("patient_id", F.lit("CREAT").alias("code"))
        refresh(spark, store, accepted.select(*SERIES).unionByName(kidney).distinct(), "fhir", number, options)

    return _start(fhir_uploads(spark, folder, files), batch, checkpoint)


def _start(stream: DataFrame, batch, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _status(spark: SparkSession, store: Store) -> Ledger:
    return Ledger(spark, store.status, [*SERIES, "derived", "version"], keep=lambda rows: _of_latest(rows, rows))


def _signals(spark: SparkSession, store: Store) -> Ledger:
    return Ledger(spark, store.signals, [*SERIES, "derived", "version", "rule"], keep=lambda rows: _of_latest(rows, _status(spark, store).read()))


def refresh(spark: SparkSession, store: Store, touched: DataFrame, feed: str, number: int, options: Options) -> None:
    """Recompute the touched series, however late their new results are. A series that is refreshed twice at
    the same time by two feeds keeps the later version."""
    touched = checkpointed(touched)
    version = F.lit(time.time_ns()).alias("version")
    results = tables.results_ledger(spark, store.results).of_patients(touched).join(touched, SERIES, "left_semi")
    computed = checkpointed(reports.reports(results, current_demographics(spark, store), options))
    found = signals.explode_signals(computed).select("*", version)
    _signals(spark, store).insert(checkpointed(found), feed, number, once=False)
    status = computed.select("patient_id", "code", "derived", "status", "status_rank", version)
    _status(spark, store).insert(checkpointed(status), feed, number, once=False)


def current_demographics(spark: SparkSession, store: Store) -> DataFrame:
    """Latest row per patient of the log, nulls included."""
    return tables.read_demographics(spark, store.demographics)


def _of_latest(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the last refresh of their (patient, code). The derived eGFR series follows its
    creatinine series: one that a refresh no longer produces is gone."""
    log = log.where("NOT derived").select("patient_id", "code", "version")
    kidney = log.where("code = 'CREAT'").withColumn("code", F.lit("EGFR"))
    latest = (
        log.withColumn("derived", F.lit(False))
        .unionByName(kidney.withColumn("derived", F.lit(True)))
        .groupBy("patient_id", "code", "derived")
        .agg(F.max("version").alias("version"))
    )
    return rows.join(latest, [*SERIES, "derived", "version"], "left_semi")


def current_status(spark: SparkSession, store: Store) -> DataFrame:
    """Latest status of every series."""
    log = _status(spark, store).read()
    return _of_latest(log, log).drop("version")


def current_signals(spark: SparkSession, store: Store) -> DataFrame:
    """Signals of the latest refresh of each series; a refresh without signals clears the old ones."""
    return _of_latest(_signals(spark, store).read(), _status(spark, store).read()).drop("version")
