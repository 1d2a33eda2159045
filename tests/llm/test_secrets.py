"""Candidates of a secret scan, labels that meet none, and the forest on planted findings it has not seen."""

import os

import pytest
from pyspark.sql import functions as F

from labtide.llm import secrets
from labtide.llm.common import settled, table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("API_KEY=sk_live_51HabcDEFghi", "sk_live_51HabcDEFghi"),
        ('password: "Sh0rt!p@ss9"', "Sh0rt!p@ss9"),
        ("a qwmzkxhvbnrtplgfdsjcyuwe b", "qwmzkxhvbnrtplgfdsjcyuwe"),
        ("client_secret => 'two words'", "two words"),
        ('{"authToken": "x"}', "x"),
        ("db_passwd=a;", "a"),
        ("secret: dGhpcyBpcyBhIHRlc3Q=, next", "dGhpcyBpcyBhIHRlc3Q="),
        ("postgres://me:pa55@host/db", "pa55"),
        ('my token = "unclosed', "unclosed"),
        ("Bearer abcdefghijkl", "abcdefghijkl"),
        ("mot de passe secret: été!", "été!"),
        ("url:token=abc", "abc"),
    ],
)
def test_values_are_candidates_without_their_names(text, wanted):
    assert wanted in {text[a:b] for a, b in secrets.spans(text)}


@pytest.mark.parametrize("text", ["", " ", "key", "password", "password:", "password = \n", 'token: ""', "short words only", "=" * 50, "a:b=c"])
def test_texts_without_candidates(text):
    assert secrets.spans(text) == []


def test_every_candidate_has_finite_features(spark):
    odd = ["token: x", "token: " + "\U0001f600" * 40, "secret='" + "a" * 50_000 + "'", "b" * 20_000, None, ""]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(odd)], "doc_id int, text string, value string")
    found = secrets.candidates(docs, secrets.statistics(docs))
    rows = found.withColumn("bad", F.exists("features", lambda x: F.isnan(x) | x.isNull())).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3} and not any(r.bad for r in rows)
    assert {(r.start, len(r.value)) for r in rows if r.doc_id == 1} == {(7, 40)}


def test_labels_without_a_candidate_are_reported(spark):
    docs = spark.createDataFrame([(1, "password: abc")], "doc_id int, text string")
    found = settled(secrets.candidates(docs, secrets.statistics(docs)))
    labels = spark.createDataFrame([(1, 10, 1), (1, 0, 0), (2, 10, 1)], "doc_id int, start long, is_secret int")
    assert {(r.doc_id, r.start) for r in secrets.unmatched(found, labels).collect()} == {(1, 0), (2, 10)}
    assert secrets.unmatched(found, labels.withColumn("length", F.lit(2))).count() == 3
    # one label meets a candidate: no forest, the smoothed share
    assert secrets.train(found, labels) == pytest.approx(2 / 3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_planted_findings_that_were_held_out(spark):
    docs = table(spark, SF, "documents")
    known = secrets.statistics(docs)
    corpus, labels = secrets.planted(docs.where("doc_id % 3 > 0"))
    model = secrets.train(secrets.candidates(corpus, known), labels)
    others, truth = secrets.planted(docs.where("doc_id % 3 = 0"), seed="other")
    found = settled(secrets.candidates(others, known))
    assert secrets.unmatched(found, truth.where("is_secret = 1")).count() == 0
    scored = secrets.scan(found, model).withColumn("length", F.length("value"))
    rows = truth.join(scored.withColumnRenamed("is_secret", "said"), ["doc_id", "start", "length"])
    hit, said, true = rows.agg(F.sum(F.col("said").cast("int") * F.col("is_secret")), F.sum(F.col("said").cast("int")), F.sum("is_secret")).first()
    assert true > 500 and hit / true >= 0.9 and hit / said >= 0.9
    # what the documents hold themselves, words and numbers, is left alone
    own = scored.join(truth, ["doc_id", "start", "length"], "left_anti").where("value RLIKE '^([a-z]+|[0-9]+)$'")
    assert own.where("is_secret").count() <= 0.02 * own.count()
