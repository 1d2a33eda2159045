"""Registered text queries over the small driver tables: against their SQL, or by held-out accuracy."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import brute
import corpus_pipeline
from labtide.llm import oracle, queries
from labtide.llm.common import settled, table

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"
#: The smaller table has six toxic documents that are held out.
MORE_LABELS = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_everything_is_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {name[: name.index("_") + 1] for name in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= contract.queries().keys() and oracle.QUERIES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_equals_its_sql(spark, other_engine, name):
    df, result = queries.QUERIES[name](spark, SF), other_engine.sql(oracle.QUERIES[name])
    names = sorted(result.columns)
    assert sorted(df.columns) == names
    theirs = [tuple(r[result.columns.index(c)] for c in names) for r in result.fetchall()]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(theirs)


@pytest.mark.parametrize(
    "name, label, folder, recall, precision",
    [("op3_quality", "quality", LABELLED, 0.97, 0.95), ("op7_toxicity", "toxic", MORE_LABELS, 0.85, 0.9)],
)
def test_held_out_accuracy(spark, name, label, folder, recall, precision):
    found = queries.QUERIES[name](spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id")
    hit, marked, true = found.agg(
        F.sum(F.col("predicted") * F.col(label)), F.sum("predicted"), F.sum(label)
    ).first()
    assert hit / true >= recall and hit / marked >= precision


def test_held_out_text_is_likelier_than_by_its_words_alone(spark):
    rows = queries.QUERIES["op9_lm_scoring"](spark, LABELLED).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_assigned_tokens_are_secrets_and_numbers_are_not(spark):
    found = queries.QUERIES["op2_secret_scan"](spark, LABELLED)
    docs = table(spark, LABELLED, "documents")
    rows = found.join(docs, "doc_id").selectExpr("is_secret", "substr(text, start + 1, length) AS value").collect()
    assert any(r.is_secret for r in rows) and all(r.is_secret == (not r.value.isdigit()) for r in rows if r.value.isdigit() or len(r.value) == 40)


def test_pipeline_equals_its_stages_one_by_one(spark):
    """Stages after the robust estimate, each by its plain reading, on what the one before kept."""
    docs = table(spark, SF, "documents")
    first = settled(corpus_pipeline.quality_rules(spark, docs, SF))
    clean = {r.doc_id for r in docs.collect() if not brute.base_counts(r.text)[5]}
    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) <= clean and len(kept) > 0.9 * len(clean)
    texts = {d: v[3] for d, v in brute.line_dedup([(d, r.text) for d, r in kept.items()]).items()}
    groups = brute.near_duplicates(list(texts.items()))
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = brute.contamination(list(texts.items()), items)
    texts = {d: t for d, t in texts.items() if not dirty[d][4]}
    sizes = {}
    for d, t in texts.items():
        sizes[kept[d].source] = sizes.get(kept[d].source, 0) + len(brute.words(t))
    goal = brute.mix_targets(sizes)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out}.items() <= texts.items()
    for source in sizes:
        assert sum(r.mix_taken for r in out if r.source == source) == pytest.approx(goal[source], abs=1.01)
