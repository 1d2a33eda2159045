"""Importance resampling against a plain reading, with ties, odd rows and brackets that miss."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from labtide.llm import resampling

SCHEMA = "doc_id long, text string, row string, score string, rank string, turn string"


def _runs(text):
    w = brute.ALNUM.findall(brute.ascii_lower(text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _plain(docs, target, share=25, least=20, buckets=10_000):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for run in _runs(text)[1]:
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, eligible = [], []
    for i, (d, text) in enumerate(docs):
        w, runs = _runs(text)
        weight = sum(gain[bucket(r)] for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(runs), weight, score, None])
        if len(w) >= least:
            eligible.append((-score, d is None, d or 0, i))
    for rank, (*_, i) in enumerate(sorted(eligible)[: share * len(eligible) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def _texts(seed, n):
    r = np.random.default_rng(seed)
    words = np.array([*(f"w{i}" for i in range(300)), "Über", "ÀB", "THE", "x-y"])
    return [" ".join(words[r.integers(0, len(words), r.integers(0, 60))]) for _ in range(n)]


TARGET = ["w1 w2 w3 the über", None, "", "w7 W8 w9 " * 20]


def _found(spark, docs, **options):
    df = spark.createDataFrame([(d, t, "r", "s", "k", "t") for d, t in docs], SCHEMA).repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    weights = resampling.gains(resampling.bucket_counts(df), resampling.bucket_counts(target))
    rows = resampling.resampled(resampling.scores(df, weights), **options).collect()
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows), key=str)


def test_equals_a_plain_reading(spark):
    docs = [*enumerate(_texts(3, 300)), (900, None), (901, " \n"), (902, "one"), (903, "very long " * 30_000)]
    assert _found(spark, docs) == _plain(docs, TARGET)


@pytest.mark.parametrize("margin, accuracy", [(1e-9, 10), (1e-3, 2), (0.4, 10_000)])
def test_a_bracket_that_misses_is_widened(spark, margin, accuracy):
    docs = list(enumerate(_texts(4, 120)))
    assert _found(spark, docs, margin=margin, accuracy=accuracy) == _plain(docs, TARGET)


def test_a_third_of_all_rows_alike_and_rows_without_id(spark):
    """Repeated rows share one score and id, across the cut as well; without id they come after the others."""
    texts = _texts(5, 60)
    docs = [*enumerate(texts), *[(7, "w5 w6 " * 15)] * 40, *[(None, "w5 w6 " * 15)] * 30]
    for share in (3, 25, 50, 100):
        assert _found(spark, docs, share=share) == _plain(docs, TARGET, share=share)


def test_nothing_to_draw(spark):
    docs = [(1, "few words"), (2, None), (3, "w " * 25)]
    assert _found(spark, docs) == _plain(docs, TARGET)
    empty = spark.createDataFrame([], SCHEMA)
    weights = resampling.gains(resampling.bucket_counts(empty), resampling.bucket_counts(empty))
    assert set(weights) == {0} and resampling.resampled(resampling.scores(empty, weights)).collect() == []


def test_drawn_documents_keep_all_columns(spark):
    docs = list(enumerate(_texts(6, 80)))
    df = spark.createDataFrame([(d, t, "r", "s", "k", "t") for d, t in docs], SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    drawn = resampling.drawn(df, target)
    assert drawn.columns == df.columns
    want = {d for d, *_, rank in _plain(docs, TARGET) if rank}
    assert {(r.doc_id, r.text, r["rank"]) for r in drawn.collect()} == {(d, t, "k") for d, t in docs if d in want}


def test_buckets_of_runs():
    for text in ["", "One", "one two  THREE-4", "Über\x00x É1"]:
        n, found = resampling.text_buckets(text.encode())
        words, runs = _runs(text)
        assert n == len(words) and sorted(found) == sorted(zlib.crc32(r.encode()) % 10_000 for r in runs)
    assert resampling.text_buckets(None)[0] == 0 and re.fullmatch(r"\d+", str(len(resampling.gains(np.zeros(5), np.ones(5)))))


def test_only_the_bracket_and_the_draw_are_sorted(spark):
    docs = list(enumerate(_texts(8, 400)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = resampling.scores(df, [0] * 10_000).withColumn("turn", F.monotonically_increasing_id()).cache()
    count = rows.where("n_words >= 20").count()
    last = resampling.cutoff(rows.where("n_words >= 20").select("score", "doc_id", "turn"), count, count // 4)
    above = rows.where("n_words >= 20").where(F.col("score") > last["score"]).count()
    assert above < count // 4 <= above + rows.where(F.col("score") == last["score"]).count()
