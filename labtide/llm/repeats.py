"""Substring dedup by relative Lempel-Ziv parsing against anchor-indexed reference blocks.

A window is `window` consecutive words. Words covered by a window that also starts in a document with a
smaller id are removed; every window is judged on the input.

Reference blocks: the smallest hash among the `anchor`-word sequences inside a window is the window's
anchor. Equal windows have equal anchors, so the windows of one anchor, in all documents, form a block,
and a window can only be found in its own block. Every document is therefore parsed against every block
that could hold any part of it, and no document meets the others.

Factors: neighbouring windows with the same anchor form a run. The parse takes a run as a whole, as long
as it goes: if its words also occur as a run of an earlier document, all of it is a factor, whatever the
number of documents that share it, since only the smallest id per content is kept. Neighbouring factors
join into longer ones. Where a factor ends, the text departs from the reference inside a run; such runs,
one for each different content of a block, are checked window by window at these factor boundaries.

Only hashes are shuffled for the parse: about one run per twenty words. Contents shared by many documents
shrink before the shuffle. Contents are compared by two 64-bit hashes, of the anchor and of all words of
the run; windows by two 64-bit hashes of their words.

Defined cases: null or blank texts have no words; texts shorter than a window keep all words; a document
without id is no reference and loses nothing; rows that repeat an id, with the same text or another one, are never earlier
than each other, and each loses what its own text repeats of smaller ids.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import settled
from labtide.llm.shingling import BASES, Rolling, WordHashes, binary, chunks, sliding_min, spaced

WINDOW = 50
ANCHOR = 12


def runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """anchor, content, doc_id, row (hash of the text), first and last window start of every run of every document with an id."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, rows = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            for first, texts in chunks(binary(batch["text"]), spaced):
                n = np.array([len(t) for t in texts], np.int64)
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                codes = hashes.of([w for t in texts for w in t])
                if len(codes) < window:
                    continue
                least = sliding_min(Rolling(codes, BASES[0]).windows(anchor), window - anchor + 1)
                owner = np.repeat(np.arange(len(n)), n)[: len(least)]
                inside = np.arange(len(least)) + window <= (begin + n)[owner]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                starts = np.flatnonzero(new & inside)
                if not len(starts):
                    continue
                edge = np.flatnonzero(new | ~inside)
                after = np.searchsorted(edge, starts, "right")
                ends = np.append(edge, len(least))[after]
                content = Rolling(codes, BASES[1]).runs(starts, ends + window - 1)
                at = begin[owner[starts]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[starts].view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(ids[first + owner[starts]].astype(np.int64)), pa.array(rows[first + owner[starts]].astype(np.int64)),
                        pa.array((starts - at).astype(np.int32)), pa.array((ends - 1 - at).astype(np.int32)),
                    ],
                    names=["anchor", "content", "doc_id", "row", "first", "last"],
                )

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _row(), "text")
    return rows.mapInArrow(parse, "anchor long, content long, doc_id long, row long, first int, last int")


def _row() -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64("text").alias("row")


def _boundary_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Both hashes of each window of the runs in `spans`, with document, row and start."""
    hashes = WordHashes()
    for batch in batches:
        ids, rows = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
        for i, (text, spans) in enumerate(zip(binary(batch["text"]), batch["spans"].to_pylist())):
            codes = hashes.of(spaced(text))
            at = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
            one, two = (Rolling(codes, b).runs(at, at + window) for b in BASES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(at), ids[i], np.int64)),
                    pa.array(np.full(len(at), rows[i], np.int64)), pa.array(at.astype(np.int32)),
                ],
                names=["one", "two", "doc_id", "row", "first"],
            )


def repeated_spans(docs: DataFrame, placed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, row and the merged-in-no-order spans of window starts found in earlier documents.

    `placed` holds doc_id, row and text of the documents with an id, partitioned by both.
    """
    every = settled(runs(docs, window, anchor))
    met_blocks = every.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # only blocks that several documents meet in go on
    parsed = settled(every.join(met_blocks.select("anchor"), "anchor", "left_semi"))
    contents = parsed.groupBy("anchor", "content").agg(F.min("doc_id").alias("earliest"))
    blocks = contents.groupBy("anchor").agg(F.min("earliest").alias("least"), F.max("earliest").alias("most"))
    blocks = blocks.where(F.col("most") > F.col("least")).select("anchor", F.lit(True).alias("mixed"))
    known = contents.join(blocks, "anchor", "left").select(
        "anchor", "content", "earliest", F.coalesce("mixed", F.lit(False)).alias("mixed")
    )
    # a content's earliest document has none before it to lean on: its runs in mixed blocks are the boundaries
    met = parsed.join(known, ["anchor", "content"]).where((F.col("earliest") < F.col("doc_id")) | F.col("mixed"))
    met = met.select("doc_id", "row", F.struct("first", "last").alias("span"), (F.col("earliest") < F.col("doc_id")).alias("whole"))
    per_doc = met.groupBy("doc_id", "row").agg(
        F.collect_list(F.when(F.col("whole"), F.col("span"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.col("span"))).alias("spans"),
    )
    boundary = placed.join(per_doc.where(F.size("spans") > 0).select("doc_id", "row", "spans"), ["doc_id", "row"])
    single = boundary.select("doc_id", "row", "text", "spans").mapInArrow(
        lambda batches: _boundary_windows(batches, window), "one long, two long, doc_id long, row long, first int"
    )
    earliest = single.groupBy("one", "two").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    earliest = earliest.where(F.col("latest") > F.col("earliest")).select("one", "two", "earliest")
    late = single.join(earliest, ["one", "two"]).where(F.col("earliest") < F.col("doc_id"))
    extra = late.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", F.col("first").alias("last"))).alias("single"))
    return per_doc.select("doc_id", "row", "whole").join(extra, ["doc_id", "row"], "full").select(
        "doc_id", "row",
        F.concat(
            F.coalesce("whole", F.array().cast("array<struct<first:int,last:int>>")),
            F.coalesce("single", F.array().cast("array<struct<first:int,last:int>>")),
        ).alias("spans"),
    ).where(F.size("spans") > 0)


def _remove(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, removed, kept = [], [], []
        for text, spans in zip(binary(batch["text"]), batch["spans"].to_pylist()):
            w = spaced(text)
            total = len(w)
            if spans:
                turns = np.zeros(total + 1, np.int64)
                np.add.at(turns, [s["first"] for s in spans], 1)
                np.add.at(turns, [s["last"] + window for s in spans], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0)]
            words.append(total)
            removed.append(total - len(w))
            left = b" ".join(w)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        last = pa.array(kept) if digest else pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), last],
            names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
        )


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space; or their SHA-256) of each row."""
    if not 0 < anchor <= window:
        raise ValueError("the anchor must have at least one word and at most as many as the window")
    plain = docs.select("doc_id", "text")
    placed = plain.where("doc_id IS NOT NULL").select("doc_id", _row(), "text").repartition("doc_id", "row")
    spans = repeated_spans(plain, placed, window, anchor)
    none = plain.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    found = placed.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans").unionByName(none)
    kind, last = dict(docs.dtypes)["doc_id"], "kept_sha256" if digest else "kept"
    return found.mapInArrow(
        lambda batches: _remove(batches, window, digest), f"doc_id {kind}, n_words long, n_removed long, {last} string"
    )
