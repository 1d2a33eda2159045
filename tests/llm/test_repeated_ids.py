"""Rows that share an id but not the text, ties at the cut, and rows repeated as they are."""

import random

import brute
from pyspark.sql import functions as F

from labtide.llm import jaccard, mixing, repeats

R = random.Random(11)
WORDS = [f"v{i}" for i in range(300)]


def _text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_repeats_of_each_text_of_an_id(spark):
    passage = _text(60)
    rows = [(1, f"{_text(40)} {passage} {_text(10)}"), (2, f"{_text(150)} {passage}"), (2, "short one"), (2, f"{passage} {_text(70)}"), (3, passage), (3, passage), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(docs).collect())
    want = []
    for d, t in rows:
        earlier = {tuple(w[i : i + 50]) for e, u in rows if e < d for w in [brute.words(u)] for i in range(len(w) - 49)}
        w = brute.words(t)
        gone = {p for i in range(len(w) - 49) if tuple(w[i : i + 50]) in earlier for p in range(i, i + 50)}
        want.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert found == sorted(want) and sum(n for _, _, n, _ in found) == 240


def test_links_of_each_text_of_an_id(spark):
    one, two = _text(80), _text(80)
    near = " ".join([*one.split()[:-1], "other"])
    rows = [(5, one), (5, two), (7, near), (7, near), (8, two), (9, _text(30)), (9, None), (None, one)]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, row string").repartition(3)
    found = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.n_shingles > 0) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(False, 5, 5, True)] * 2 + [(False, 7, 5, True)] * 2 + [(False, 8, 5, True), (False, 9, 9, True), (False, 9, 9, False), (True, None, None, True)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(5, one), (5, two), (9, rows[5][1]), (9, None), (None, one)], key=str)


def test_mix_meets_its_target_on_ties(spark):
    for texts in ([" ".join(f"{i}x{j}" for j in range(20)) for i in range(50)], ["the same words " * 4] * 50):
        rows = [(None, t, "a") for t in texts] + [(i, _text(7), "b") for i in range(30)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        goal = {r.source: r.target for r in mixing.shares(mixing.sizes(docs)).select("source", "target").distinct().collect()}
        taken = dict(mixing.mix(docs).groupBy("source").agg(F.sum("mix_taken")).collect())
        for source in goal:
            least = 50 if source == "a" and len(set(texts)) == 1 else 1
            assert goal[source] - least <= taken[source] <= goal[source]
