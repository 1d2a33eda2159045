"""Nulls, empty and very long texts, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labtide.llm import decontaminate, jaccard, lines, maxent, mixing, quality, repeats, rules, secrets, toxicity
from labtide.llm.common import settled

CLASHING = ["row", "key", "size", "f1", "drop", "lines", "kept", "group", "n_words", "score", "hits", "component", "turn", "kept_id", "mix_words", "cut_at", "t", "w"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = "very long text " * 40_000
TEXTS = [None, "", " \n\t ", "one", "same words here " * 30, "same words here " * 30, LONG, 'key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" idiot', "x\n" * 3000]


def _rows(texts):
    extra = tuple(CLASHING)
    rows = [(i + 1, t, "en" if i % 2 else None, "s" if i % 3 else None, None, *extra) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "without id " * 8, None, None, None, *extra), (None, None, None, None, None, *[None] * len(CLASHING))]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "odd": spark.createDataFrame(_rows(TEXTS), SCHEMA).repartition(3),
        "empty": spark.createDataFrame([], SCHEMA),
    }


@pytest.fixture(scope="module")
def others(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, None, None), (4, 0, 0), (5, 1, 0), (8, 0, 1), (9, 0, 0), (None, 1, 1), (77, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"
    )
    benchmark = spark.createDataFrame([(1, "very long text very"), (2, None), (None, "one"), (3, "")], "item_id long, text string")
    return {"labels": labels, "benchmark": benchmark, "no_labels": labels.where("false"), "no_benchmark": benchmark.where("false")}


def _operators(others, none):
    labels, benchmark = others["no_labels" if none else "labels"], others["no_benchmark" if none else "benchmark"]

    def scanned(docs):
        known = secrets.statistics(docs)
        corpus, marks = secrets.planted(docs)
        return secrets.scan(secrets.candidates(docs, known), secrets.train(secrets.candidates(corpus, known), marks))

    return {
        "mixture": lambda d: mixing.shares(settled(mixing.sizes(d))),
        "secrets": scanned,
        "quality": lambda d: quality.score(d, quality.learn(d, labels, F.lit(True))),
        "jaccard": jaccard.near_duplicates,
        "repeats": repeats.without_repeats,
        "lines": lines.with_kept_lines,
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels, F.lit(True))),
        "contamination": lambda d: decontaminate.contamination(d, benchmark),
        "language model": lambda d: maxent.score(d, *maxent.fit(d, F.lit(not none))),
        "rules": rules.report,
    }


NAMES = list(_operators({"labels": 0, "no_labels": 0, "benchmark": 0, "no_benchmark": 0}, False))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_keep_their_number(tables, others, name):
    docs = tables["odd"]
    found = _operators(others, False)[name](docs).collect()
    if name != "secrets":
        assert len(found) == docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_without_labels_or_benchmark(tables, others, name):
    found = _operators(others, True)[name](tables["odd"])
    scores = [r["score"] for r in found.collect() if "score" in found.columns]
    if name in ("quality", "toxicity"):
        assert scores and all(s == pytest.approx(0.5) for s in scores)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(tables, others, name):
    assert _operators(others, False)[name](tables["empty"]).collect() == []


def test_defined_cases(tables, others):
    docs = tables["odd"]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert near[1] == near[2][:1] + (1,) and near[2] == (0, 2) and near[3] == (0, 3) and near[6] == (3, 5) and near[None][1] is None
    left = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.without_repeats(docs).collect()}
    assert left[5] == (90, 0) and left[6] == (90, 90) and left[1] == (0, 0) and left[None][1] == 0
    hit = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, others["benchmark"]).collect() if r.doc_id}
    assert hit[4] == (1, 1, []) and hit[7] == (120_000, 119_998, [1]) and hit[1] == (0, 0, [])
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 5, 7, 8, 9] and kept.count(None) == 2


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_stages(spark, tables, tmp_path, kind):
    folder = str(tmp_path / "sf")
    docs = tables[kind]
    spark.createDataFrame([(1, "very long text very")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        if name != "source mixing":
            assert docs.columns == before
        docs = settled(docs)
    assert set(corpus_pipeline.STAGES[-1][0].split()) and (docs.count() == 0 if kind == "empty" else True)
