"""Importance resampling to a target distribution: array-scored weights, a bracketed cutoff, distributed ranks.

Features are all runs of one and two words, hashed into `BUCKETS` buckets. One pass over each table counts the
buckets; a bucket's gain is the logarithm of its smoothed share in the target over that in the documents. A second
pass looks up the gains of a document's buckets in one array and takes their mean; a repeatable Gumbel number of the
document id is added, so that the highest scores are a draw without replacement by weight.

The draw's cutoff comes from a bracket. A quantile sketch names two scores around it; exact counts of the rows above,
inside and below tell whether the cutoff lies between them, and if not, the bracket is widened and counted again, at last to all rows.
Only the bracket is sorted to find the row on the cutoff. The rows drawn are then numbered by one range sort and the
prefix sum of its parts. Scores, counts and numbers are settled before they are used twice; no task or driver
ever holds more than the counts of buckets and parts. Gains are `BUCKETS` numbers, sent with the tasks.

Defined cases: a null, empty or wordless text has no features, weight 0, and is never drawn (nor is any below
`least_words`); a null id hashes as the empty text and comes last among equal scores; rows equal in score and id
are drawn in a fixed order of their own; an empty target gives gains from the smoothing alone; an
empty table gives an empty result. `drawn` returns every column of the documents, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from labtide.llm.common import settled
from labtide.llm.decontaminate import text_words

BUCKETS = 10_000
LEAST_WORDS = 20
#: Per cent of the eligible documents that are drawn.
SHARE = 25
SEED = "7"
SCALE = 1000
#: The sketch's accuracy, and the half width of the first bracket as a share of the rows.
ACCURACY = 10_000
MARGIN = 1e-3
#: Rows numbered by one task of the last sort, about.
PART_ROWS = 1_000_000


def text_buckets(text: bytes | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one or two words, repeats included."""
    words = text_words(text)
    single = list(map(crc32, words))
    spaced = map(crc32, repeat(b" "), single[:-1])
    double = map(crc32, words[1:], spaced)  # the checksum of a pair goes on from that of its first word
    return len(words), np.fromiter((*single, *double), np.int64, max(0, 2 * len(words) - 1)) % buckets


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; every task sends one row for each bucket it saw."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                total += np.bincount(text_buckets(text, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * ln of the smoothed target share over the smoothed document share) per bucket."""
    buckets, all_docs, all_target = len(of_docs), float(of_docs.sum()), float(of_target.sum())
    return [
        math.floor(scale * math.log((t + 1.0) * (all_docs + buckets) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(of_docs.tolist(), of_target.tolist())
    ]


def _gumbel(doc_id: Column, seed: str, scale: int) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(share))).cast("long")


def scores(docs: DataFrame, weights: list[int], seed: str = SEED, scale: int = SCALE, row: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, with the whole document in `row` if wanted."""
    table, buckets = np.array(weights, np.int64), len(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [(n, found) for n, found in (text_buckets(t, buckets) for t in _texts(batch))]
            rest = [name for name in batch.schema.names if name != "text"]
            found = {
                "n_words": [n for n, _ in counted], "n_features": [len(b) for _, b in counted],
                "weight": [int(table[b].sum()) // len(b) if len(b) else 0 for _, b in counted],
            }
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in rest), *(pa.array(v, pa.int64()) for v in found.values())], names=[*rest, *found]
            )

    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row else []
    sent = docs.select("doc_id", F.col("text").cast("string").alias("text"), *whole)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent.schema if f.name != "text")
    found = sent.mapInArrow(weigh, f"{kinds}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed, scale))


def _after(found: Row) -> Column:
    """Whether a row comes after the found one: lower score, then greater id (null last), then greater turn."""
    score, doc_id, turn = F.col("score"), F.col("doc_id"), F.col("turn")
    late = F.when(doc_id.isNull(), F.lit(True)).otherwise(doc_id > F.lit(found["doc_id"])) if found["doc_id"] is not None else F.lit(False)
    same = doc_id.eqNullSafe(F.lit(found["doc_id"]))
    return (score < found["score"]) | ((score == found["score"]) & ((~same & late) | (same & (turn > found["turn"]))))


_ORDER = [F.desc, lambda c: F.col(c).asc_nulls_last(), F.asc]


def _order() -> list[Column]:
    return [kind(c) for kind, c in zip(_ORDER, ("score", "doc_id", "turn"))]


def numbered(rows: DataFrame, count: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with `rank`, 1 for the highest score: sorted by ranges, numbered in each, plus the rows of the ranges before."""
    session = rows.sparkSession
    parts = max(1, -(-count // part_rows), min(count // 10_000, session.sparkContext.defaultParallelism))
    in_order = rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    # an id made of the part's number and the row's place in it
    placed = settled(in_order.withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("part")).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("before") + at + 1).drop("part", "place", "before")


def cutoff(eligible: DataFrame, count: int, wanted: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> Row | None:
    """The row that takes place `wanted` by score, id and turn among the `count` eligible ones; null if none is wanted."""
    if wanted < 1:
        return None
    while True:
        share = 1 - wanted / count
        ends = [max(0.0, share - margin), min(1.0, share + margin)]
        low, high = eligible.agg(F.percentile_approx("score", F.array(*map(F.lit, ends)), accuracy)).first()[0]
        if ends == [0.0, 1.0]:
            low, high = eligible.agg(F.min("score"), F.max("score")).first()
        above, inside = eligible.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            bracket = eligible.where(F.col("score").between(low, high)).select("score", "doc_id", "turn")
            return numbered(bracket, inside).where(F.col("rank") == wanted - above).first()
        margin *= 8


def resampled(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, margin: float = MARGIN, accuracy: int = ACCURACY) -> DataFrame:
    """All rows of `scores` with `rank`: 1, 2, 3... for the drawn ones from the highest score on, null for the others."""
    rows = settled(scored.withColumn("turn", F.monotonically_increasing_id()))
    eligible = rows.where(F.col("n_words") >= least_words)
    count = eligible.count()
    wanted = share * count // 100
    last = cutoff(eligible.select("score", "doc_id", "turn"), count, wanted, margin, accuracy)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("*", none).drop("turn")
    chosen = (F.col("n_words") >= least_words) & ~_after(last)
    drawn_rows = numbered(rows.where(chosen), wanted)
    return drawn_rows.select(*rows.columns, "rank").unionByName(rows.where(~chosen).select("*", none)).drop("turn")


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The documents of the draw, all columns."""
    weights = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    found = resampled(scores(docs, weights, seed, row=True), share, least_words)
    return found.where("rank IS NOT NULL").select("row.*")
