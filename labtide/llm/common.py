"""What the text operators share: word rules as expressions, lineage cuts and row fingerprints."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, a line key or a token.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str | Column) -> Column:
    """The text, the empty string for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Maximal runs of non-space characters, in order; an empty array for null or blank text."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def fingerprint(*columns: Column, salt: str = "") -> list[Column]:
    """Two 64-bit hashes with different seeds; a null differs from every value and from its neighbour's null."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(salt + seed), *parts) for seed in ("first", "second")]


def train_bucket(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame written once to the checkpoint folder, so that later passes and lost executors read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows handed to Python at a time, for what is run inside: long texts fill the memory of larger batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def least_count(words: DataFrame, most: int) -> int:
    """The least count n such that at most `most` rows of `words` have it or more, to within a sixteenth of a doubling.

    Found from the number of rows per fine range of counts, so nothing is sorted or gathered.
    """
    fine = F.floor(F.log2("n") * 16).cast("int")
    ranges = words.groupBy(fine.alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    least, held_rows = 1 << 62, 0
    for r in sorted(ranges, key=lambda r: -r["range"]):
        if held_rows + r["rows"] > most:
            break
        least, held_rows = r["least"], held_rows + r["rows"]
    return least


def sampled(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most `most` rows: those with the smallest hash of `columns`.

    A bound on the hash, from the number of rows, keeps about as many rows as are wanted in every task;
    only these are sorted.
    """
    total = df.count()
    key = F.xxhash64(*columns)
    if total > most:
        df = df.where(F.shiftrightunsigned(key, 11) < int(min(1.0, 1.5 * most / total + 100 / total) * (1 << 53)))
    return df.orderBy(key, *columns).limit(most)


def held(df: DataFrame) -> DataFrame:
    """The same rows through a one-element generator, which a later filter does not pass.

    Pushed further down, a filter would repeat the expressions behind its columns, step within step.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
