"""Line dedup: lines whose key occurs in many documents are dropped, the others are put together again.

A text is split at \\n. A line's key is the line without white space at both ends, A-Z in lower case.
Keys are exploded as two 64-bit hashes, once per document, and counted; keys found in at least
`documents` documents lose all their lines. Only hashes and positions are shuffled for that, never the
lines; the text moves once, to meet the positions that it loses.

Defined cases: a null text is one empty line and stays null in `drop_lines`; the empty key is never
counted, so blank lines stay; every row is a document, so a repeated row counts again; rows that agree
in id and text get the same result; a null doc_id is an id like any other. An empty table gives an empty
result. Other columns pass through `drop_lines` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import SPACES, ascii_lower, fingerprint, settled, whole

#: A key found in so many documents loses all its lines.
DOCUMENTS = 10
KEY_CHARS = 1


def _keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashes(text: Column, least: int) -> Column:
    """Two hashes of each line's key in line order; null for keys that are too short."""
    return F.transform(
        _keys(text),
        lambda key: F.when(
            F.length(key) >= least,
            F.struct(F.xxhash64(F.lit("a"), key).alias("a"), F.xxhash64(F.lit("b"), key).alias("b")),
        ),
    )


def frequent_positions(docs: DataFrame, documents: int = DOCUMENTS, key_chars: int = KEY_CHARS) -> DataFrame:
    """First and second fingerprint (f1, f2) of (doc_id, text), and the sorted positions of the lines to drop.

    Documents that lose nothing have no row.
    """
    text = whole("text")
    f1, f2 = fingerprint(F.col("doc_id"), F.col("text"))
    hashed = settled(docs.select(f1.alias("f1"), f2.alias("f2"), _hashes(text, max(1, key_chars)).alias("lines")))
    once = hashed.select(F.explode(F.array_distinct("lines")).alias("key")).where("key IS NOT NULL")
    frequent = once.groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= documents)
    placed = hashed.select("f1", "f2", F.posexplode("lines").alias("pos", "key")).where("key IS NOT NULL")
    placed = placed.select("f1", "f2", "pos", "key.a", "key.b")
    hit = placed.join(frequent.select("a", "b"), ["a", "b"])
    return hit.groupBy("f1", "f2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def with_kept_lines(docs: DataFrame, documents: int = DOCUMENTS, key_chars: int = KEY_CHARS) -> DataFrame:
    """Each row of `docs` as a struct `row`, with n_lines, n_dropped and the kept text."""
    f1, f2 = fingerprint(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), f1.alias("f1"), f2.alias("f2"))
    joined = rows.join(frequent_positions(docs, documents, key_chars), ["f1", "f2"], "left")
    lines = F.split(whole(F.col("row.text")), "\n", -1)
    drop = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
    split = joined.select("row", lines.alias("lines"), drop.alias("drop"))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get(F.col("lines"), i)
    )
    return split.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"),
        F.when(F.size("drop") == 0, whole(F.col("row.text"))).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS, key_chars: int = KEY_CHARS) -> DataFrame:
    """The documents without their frequent lines, same columns; n_chars, if there, follows the new text."""
    found = with_kept_lines(docs, documents, key_chars)
    changed = F.col("n_dropped") > 0
    values = {
        "text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None,
    }
    return found.select(*[
        (values[c] if c in values else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns
    ])
