"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in every document.

Words are runs of digits, ASCII letters in lower case and non-ASCII characters. A window is `window`
consecutive words of an item; an item with fewer words is one window. A window is searched word by word:
the last two words of the current position look up a shift table. A pair that is in no window lets the
search jump ahead by almost a whole window, a pair further left in a window by less. Where the shift is
zero, the pair selects a bucket of windows that end on it, the first two words narrow the bucket, and the
windows left are compared directly with the text. Windows of each length have tables of their own, as a
shorter one would shorten every jump.

Items reach the tasks in blocks of at most `block_words` words (one item larger than that is cut into
overlapping pieces, so no block grows with it); every document passes through all blocks in the same task,
and documents are never shuffled. The broadcast is bounded by the block size whatever the benchmark's size.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item is never found; an
item without id is searched and its hits count, but it is not listed; repeated items and ids count once.
An empty benchmark leaves every document clean. Columns of the documents pass through `clean` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Benchmark words broadcast at a time.
BLOCK_WORDS = 100_000

#: Bytes to word bytes: letters in lower case, digits and non-ASCII kept, everything else a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def text_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Tables:
    """Shift table and suffix buckets for the windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[bytes | tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], int, object]]]] = {}

    def _pair(self, words: list[bytes], at: int):
        return (words[at - 1], words[at]) if self.block == 2 else words[at]

    def add(self, item: object, words: list[bytes]) -> None:
        length, block = self.length, self.block
        for at in range(block - 1, len(words)):
            pair = self._pair(words, at)
            jump = max(0, length - 1 - at)
            if jump < self.shift.get(pair, length):
                self.shift[pair] = jump
            if at >= length - 1:
                start = at - length + 1
                first = tuple(words[start : start + block])
                self.buckets.setdefault(pair, {}).setdefault(first, []).append((words, start, item))

    def find(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Mark the words inside occurrences and collect the items that occur."""
        length, block, n = self.length, self.block, len(words)
        shift, far, at = self.shift, self.length - self.block + 1, self.length - 1
        while at < n:
            pair = (words[at - 1], words[at]) if block == 2 else words[at]
            jump = shift.get(pair, far)
            if jump:
                at += jump
                continue
            start = at - length + 1
            same_start = self.buckets[pair].get(tuple(words[start : start + block]))
            if same_start:
                here = words[start : at + 1]
                for pattern, offset, item in same_start:
                    if pattern[offset : offset + length] == here:
                        items.add(item)
                        hit[start : at + 1] = b"\x01" * length
            at += 1


def search_tables(items: list[tuple[object, list[bytes]]], window: int) -> list[Tables]:
    """Tables of every window length in the items, longest first. Equal windows of one item are kept once."""
    tables: dict[int, Tables] = {}
    for item, words in items:
        if words:
            length = min(window, len(words))
            tables.setdefault(length, Tables(length)).add(item, words)
    return [tables[n] for n in sorted(tables, reverse=True)]


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as word lists, at most `block_words` words a block, fetched from the cluster one partition at a time."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    block, held = [], 0
    for row in rows.toLocalIterator():
        words = text_words(bytes(row["text"]))
        for start in range(0, max(1, len(words) - window + 1), max(1, block_words - window + 1)):
            piece = words[start : start + max(window, block_words)]
            if held and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row["item_id"], piece))
            held += len(piece)
    if block:
        yield block


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def found_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (one byte per word, 1 inside an occurrence; null without any) and items, per document."""
    spark, id_type = docs.sparkSession, dict(benchmark.dtypes)["item_id"]
    out_schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_words long, hits binary, items array<{id_type}>"
    state = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"),
        F.array().cast(f"array<{id_type}>").alias("items"),
    )
    blocks = 0
    for block in _blocks(benchmark, window, block_words):
        state = state.mapInArrow(_searcher(spark.sparkContext.broadcast(block), window), out_schema)
        blocks += 1
    if not blocks:
        state = state.mapInArrow(_searcher(spark.sparkContext.broadcast([]), window), out_schema)
    return state.drop("text")


def _searcher(sent, window: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = search_tables(sent.value, window)
        for batch in batches:
            counts, hits, items = [], [], []
            for text, hit, known in zip(_as_bytes(batch["text"]), batch["hits"].to_pylist(), batch["items"].to_pylist()):
                words = text_words(text)
                marks, found = bytearray(hit) if hit else bytearray(len(words)), set()
                for t in tables:
                    t.find(words, marks, found)
                counts.append(len(words))
                hits.append(bytes(marks) if hit or any(marks) else None)
                items.append(sorted(({*known} | found) - {None}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["text"], pa.array(counts, pa.int64()), pa.array(hits, batch["hits"].type),
                    pa.array(items, batch["items"].type),
                ],
                names=["doc_id", "text", "n_words", "hits", "items"],
            )

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences) and the ids of the items found, per document."""
    found = found_items(docs, benchmark, window, block_words)
    marked = F.coalesce(F.length(F.regexp_replace(F.hex("hits"), "0", "")), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", marked.alias("n_hit"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, unchanged and unmoved."""
    kept = docs
    for block in _blocks(benchmark, window, block_words):
        kept = kept.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(block), window), docs.schema)
    return kept


def _filter(sent, window: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = search_tables(sent.value, window)
        for batch in batches:
            stay = []
            for text in _as_bytes(batch["text"]):
                words = text_words(text)
                marks = bytearray(len(words))
                for t in tables:
                    t.find(words, marks, set())
                stay.append(not any(marks))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return keep


def items_digest(ids: list) -> str:
    """Lower-case hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
