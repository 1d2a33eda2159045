"""Stored tables: idempotent inserts, upserts, the append-only log and listings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.operators.ledger import Commit, Ledger
from labtide.operators.review import reject_reason
from labtide.schemas import DEMOGRAPHICS, OBSERVATIONS
from labtide.session import checkpointed

RESULT_KEY = ["patient_id", "code", "taken_at"]


def first_wins(batch: DataFrame, sequence: str, counted: bool = False) -> DataFrame:
    """One row per result key, the earliest by ``sequence``, of equal ones the least by its values; combined before the
    shuffle, so a key repeated millions of times costs each task one row. ``counted`` adds up the column ``rows``."""
    rest = [c for c in batch.columns if c not in (*RESULT_KEY, sequence, *(["rows"] if counted else []))]
    total = [F.sum("rows").alias("rows")] if counted else []
    picked = batch.groupBy(*RESULT_KEY).agg(F.min_by(F.struct(*rest), F.struct(sequence, *rest)).alias("row"), *total)
    return picked.select(*RESULT_KEY, "row.*", *(["rows"] if counted else []))


def new_results(batch: DataFrame, stored: DataFrame, sequence: str = "seq") -> DataFrame:
    """Rows of the batch that are not stored yet, in the stored column order."""
    fresh = first_wins(batch, sequence).join(stored.select(*RESULT_KEY), RESULT_KEY, "left_anti")
    return fresh.select(*stored.columns)


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """Submitted, inserted and duplicate row counts."""
    return _counts(submitted=batch, inserted=inserted).select(
        "submitted", "inserted", (F.col("submitted") - F.col("inserted")).alias("duplicates")
    )


def _counts(**frames: DataFrame) -> DataFrame:
    """One row with the size of each frame: a union of one-row counts, then a sum."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(*[(F.col("n") if k == name else F.lit(0)).alias(k) for k in frames])
        for name, df in frames.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(*[F.sum(k).alias(k) for k in frames])


def upsert_demographics(stored: DataFrame, batch: DataFrame, sequence: str = "seq") -> DataFrame:
    """Last write per patient wins, nulls included; ``batch`` carries the sequence column, a number or the
    readers' struct of file, block and row."""
    kind = batch.schema[sequence].dataType
    old = stored.withColumn("rank", F.struct(F.lit(0).alias("batch"), F.lit(None).cast(kind).alias("seq")))
    new = batch.withColumn("rank", F.struct(F.lit(1).alias("batch"), F.col(sequence).alias("seq"))).drop(sequence)
    return (
        old.unionByName(new)
        .groupBy("patient_id")
        .agg(F.max_by(F.struct("gender", "birth_year"), "rank").alias("row"))
        .select("patient_id", "row.*")
    )


def upload_summary(batch: DataFrame, inserted: DataFrame, skipped: DataFrame, patients: DataFrame) -> DataFrame:
    """One row for a whole upload. Codes are a catalogue, so their list is bounded."""
    people = batch.select("patient_id").distinct()
    counts = _counts(submitted=batch, inserted=inserted, skipped=skipped, patients=people, demographics=patients)
    codes = batch.select("code").distinct().agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("biomarkers"))
    numbers = counts.columns
    none = F.lit(None).cast("string").alias("biomarkers")
    return (
        counts.select(*numbers, none)
        .unionByName(codes.select(*[F.lit(0).cast("long").alias(c) for c in numbers], "biomarkers"))
        .agg(*[F.sum(c).alias(c) for c in numbers], F.max("biomarkers").alias("biomarkers"))
        .select(
            "inserted", (F.col("submitted") - F.col("inserted")).alias("duplicates"), "skipped", "patients",
            "biomarkers", "demographics",
        )
    )


def skip_histogram(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    """Skip reasons, most frequent first."""
    return (
        skipped.groupBy(F.col(reason).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def biomarker_stats(observations: DataFrame) -> DataFrame:
    """Per raw code: non-null count, mean, min, max."""
    return (
        observations.groupBy("code")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
        .orderBy("code")
    )


def patient_listing(observations: DataFrame) -> DataFrame:
    """Distinct codes and results per patient, counted per (patient, code) first."""
    return (
        observations.groupBy("patient_id", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("biomarkers"), F.sum("n").alias("observations"))
        .orderBy("patient_id")
    )


def patient_codes(observations: DataFrame) -> DataFrame:
    return observations.select("patient_id", "code").distinct().orderBy("patient_id", "code")


def results_ledger(spark, path: str) -> Ledger:
    return Ledger(spark, path, RESULT_KEY, OBSERVATIONS, time="taken_at")


def append_results(spark, path: str, batch: DataFrame, sequence: str = "seq", feed: str | None = None, number: int | None = None) -> Commit:
    """Append the new results of a batch to the stored table; the first row of a key wins.

    The store is read in its own buckets and not exchanged (`operators/ledger.py`). Feed and batch number, if
    given, make a replay harmless; other writers at the same time are fine.
    """
    picked = checkpointed(first_wins(batch.withColumn("rows", F.lit(1)), sequence, counted=True))
    submitted = picked.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    done = results_ledger(spark, path).insert(picked.drop("rows"), feed, number)
    return Commit(submitted, done.inserted, done.replayed)


def read_results(spark, path: str) -> DataFrame:
    """The stored results, or an empty table before the first append."""
    return results_ledger(spark, path).read()


def demographics_ledger(spark, path: str) -> Ledger:
    return Ledger(spark, path, ["patient_id", "version"], keep=_latest_people)


def _latest_people(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("patient_id")
        .agg(F.max_by(F.struct("gender", "birth_year", "version"), "version").alias("row"))
        .select("patient_id", "row.*")
    )


def append_demographics(spark, path: str, batch: DataFrame, sequence: str = "seq", feed: str | None = None, number: int | None = None) -> Commit:
    """Append corrections; the last row of a patient in the last batch wins, nulls included.

    Batches are told apart by the version that the ledger's newest manifest gives them.
    """
    ledger = demographics_ledger(spark, path)
    picked = batch.groupBy("patient_id").agg(F.max_by(F.struct("gender", "birth_year"), sequence).alias("row"))
    version = F.lit(max(time.time_ns(), ledger.current().number)).alias("version")
    return ledger.insert(checkpointed(picked.select("patient_id", "row.*", version)), feed, number, once=False)


def read_demographics(spark, path: str) -> DataFrame:
    """Latest row per patient, nulls included; an empty table before the first append."""
    ledger = demographics_ledger(spark, path)
    if not ledger.current().generations:
        return spark.createDataFrame([], DEMOGRAPHICS)
    return _latest_people(ledger.read()).select(*DEMOGRAPHICS.names)


def append_reviews(path: str, accepted: DataFrame) -> None:
    """The only write path of the review log: rows are checked, then appended; nothing is rewritten."""
    bad = accepted.where(
        reject_reason(F.col("rule"), F.col("action"), F.col("reason")).isNotNull()
        | F.col("snapshot").isNull() | F.col("actor").isNull() | F.col("signal_t").isNull()
    )
    if not bad.isEmpty():
        raise ValueError("review events break the table's constraints; nothing was written")
    accepted.write.mode("append").parquet(path)
