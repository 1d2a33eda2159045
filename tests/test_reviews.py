"""Review log, triage and the statistics behind them."""

import math

import pytest

from helpers import START_T, WEEK, observations, weekly
from labtide.functions.stats import Z95, Z99, normal_cdf, register_sql_functions
from labtide.functions.text import iso_date, iso_instant, signed_pct, value
from labtide.operators import quality, reports, review, signals, tables, triage
from labtide.schemas import DEMOGRAPHICS, REVIEW_EVENTS
from pyspark.sql import functions as F

LAST = START_T + 12 * WEEK


def event(i, action, rule="rcv", patient="a", code="CREAT", t=LAST, reason=None):
    return (i, patient, code, rule, t, action, reason, "demo-clinician", "{}", 100 + i)


@pytest.fixture(scope="module")
def computed(spark):
    rows = weekly("a", "CREAT", [1.0] * 12 + [1.6], "mg/dL") + weekly("a", "LDL", [120.0] * 6, "mg/dL")
    rows += weekly("b", "HBA1C", [5.8] * 13, "%") + weekly("c", "TSH", [2.0] * 13, "mIU/L")
    return reports.reports(observations(spark, rows)).cache()


def events(spark, rows):
    return spark.createDataFrame(rows, REVIEW_EVENTS)


def test_state_follows_the_latest_decision_and_notes_count(spark, computed):
    history = [
        event(1, "acknowledge"), event(2, "annotate", reason="repeat in 3 months"),
        event(3, "dismiss", reason="haemolysed"), event(4, "reopen", reason="new context"),
        event(1, "acknowledge", t=LAST - WEEK), event(1, "acknowledge", rule="prri", code="LDL"),
    ]
    wanted = [("acknowledged", 0, None, 101), ("acknowledged", 1, None, 101), ("dismissed", 1, "haemolysed", 103),
              ("unreviewed", 1, None, None)]
    sig = signals.explode_signals(computed)
    for upto, (state, notes, reason, at) in enumerate(wanted, start=1):
        log = events(spark, [e for e in history[:4] if e[0] <= upto] + history[4:])
        r = review.signal_reviews(sig, log).where("patient_id = 'a' AND rule = 'rcv'").first()
        assert (r.state, r.notes, r.reason, r.decided_at) == (state, notes, reason, at)
        assert review.signal_reviews(sig, log).where("rule = 'prri'").first().state == "unreviewed"


def test_submitted_reviews_are_checked_and_snapshotted(spark, computed, tmp_path):
    rows = [
        event(1, "acknowledge"), event(2, "dismiss"), event(3, "dismiss", reason="  ok  "),
        event(4, "annotate", reason="see MRN on file"), event(5, "erase", reason="whatever"),
        event(6, "dismiss", rule="magic", reason="whatever"), event(7, "dismiss", t=LAST - WEEK, reason="old one"),
        event(8, "dismiss", reason="  known CKD, stable on review 2026-09  "),
    ]
    sig = signals.explode_signals(computed)
    accepted, rejected = review.accept(events(spark, rows).drop("snapshot"), computed, sig, 1095)
    kept = {r.id: r for r in accepted.collect()}
    assert kept.keys() == {1, 8} and kept[8].reason == "known CKD, stable on review 2026-09"
    assert '"rule":"rcv"' in kept[1].snapshot and '"status":"alert"' in kept[1].snapshot
    why = {r.id: r.reject_reason for r in rejected.collect()}
    assert why[2] == "say why, to dismiss" and "3 and 500" in why[3] and "keyword" in why[4]
    assert why[5] == "unknown action" and why[6] == "unknown rule" and "no such signal" in why[7]
    assert {r.id for r in review.stale(events(spark, rows), sig).collect()} == {6, 7}

    path = str(tmp_path / "log")
    tables.append_reviews(path, accepted)
    tables.append_reviews(path, accepted.where("id = 1"))
    assert spark.read.parquet(path).count() == 3
    assert [r.id for r in review.history(spark.read.parquet(path), "a", "creat").collect()] == [8, 1, 1]
    with pytest.raises(ValueError):
        tables.append_reviews(path, events(spark, rows))
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail jane@example.org", "an email address"), ("call 555-123-4567", "a phone number"),
        ("id 123-45-6789", "an ID number"), ("nr 1234567", "an ID number"), ("DOB on file", "an identifier keyword"),
        ("HbA1c 7.0 % after steroid course; repeat in 3 months", None),
    ],
)
def test_identifier_screen(spark, text, found):
    row = spark.range(1).select(review.identifier(F.lit(text)).alias("x")).first()
    assert row.x == found


def test_no_text_that_a_pattern_matches_is_ruled_out_beforehand(spark):
    texts = [
        "ſſn on file", "DATE OF BıRTH", "date of bİrth", "Medİcal record 5", "PATIENT NAME", "mrn", "xmrn", "dobs", "a@b.c", "@", "é@ü.x",
        "٥٥٥-١٢٣-٤٥٦٧", "(555) 123 4567", "٠١٢٣٤٥", "12345", "123-45-678", "", None, "s s n", "mob", "date of b",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = [F.when(F.rlike("text", F.lit("(?U)" + p)), what) for what, p in review.IDENTIFIERS]
    rows = df.select("text", review.identifier(F.col("text")).alias("got"), F.coalesce(*plain).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len({r.want for r in rows}) == 5


def test_triage_order_and_review_effect(spark, computed):
    ranked = triage.ranked(triage.triage(computed, events(spark, []))).collect()
    assert [r.patient_id for r in ranked] == ["a", "b", "c"]
    a = ranked[0]
    assert (a.status, a.alerts, a.watches, a.top_code, a.top_severity) == ("alert", 1, 0, "CREAT", "alert")
    assert a.top_rule == "prri" and ranked[2].top_rule is None and ranked[2].status == "normal"
    every = [event(i, "acknowledge", rule=s.rule, t=s.t) for i, s in enumerate(
        signals.explode_signals(computed).where("patient_id = 'a'").collect())]
    after = triage.ranked(triage.triage(computed, events(spark, every))).collect()
    assert [r.patient_id for r in after] == ["b", "a", "c"]
    assert after[1].status == "alert" and after[1].unreviewed == 0


def test_upsert_overwrites_even_with_null(spark):
    stored = spark.createDataFrame([("a", "female", 1960), ("b", "male", 1950)], DEMOGRAPHICS)
    batch = spark.createDataFrame(
        [("a", None, None, 2), ("a", "male", 1970, 1), ("c", "other", 1980, 3)],
        "patient_id string, gender string, birth_year int, seq long",
    )
    out = sorted(tuple(r) for r in tables.upsert_demographics(stored, batch).collect())
    assert out == [("a", None, None), ("b", "male", 1950), ("c", "other", 1980)]


def test_plausibility_rules(spark):
    data = {
        "few": [1.0, 1.1, 1.2], "out": [1.0, 0.1, 1.1, 1.2], "flat": [1.0, 1.1, 1.0, 1.1], "wide": [0.5, 1.0, 1.2, 1.9],
        "clash": [1.6, 1.7, 1.8, 1.9], "fine": [1.0, 1.1, 1.2, 1.3],
    }
    rows = [(p, "CREAT", v) for p, vs in data.items() for v in vs] + [("clash", "EGFR", 80.0)]
    df = spark.createDataFrame(rows, "patient_id string, code string, v double")
    out = {r.patient_id: r.reason for r in quality.plausibility(df).collect()}
    assert out == {
        "few": "fewer than 4 results", "out": "value outside 0.3-15.0", "flat": "fewer than 3 distinct values",
        "wide": "creatinine range > 3x", "clash": "creatinine inconsistent with eGFR", "fine": None,
    }


def test_normal_cdf_and_sql_functions(spark):
    df = spark.createDataFrame([(0.0, 0.5), (Z95, 0.975), (-Z99, 0.005)], "x double, want double")
    for r in df.select("want", normal_cdf(F.col("x")).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-6
    register_sql_functions(spark)
    r = spark.sql(
        "SELECT normal_cdf(1.959963985D) AS p, rcv_up(0.044D, 0.011D) AS up, rcv_down(0.044D, 0.011D) AS down,"
        " ckd_epi_2021(1.3D, 62D, 'female') AS egfr, ckd_epi_2021(0.9D, 50D, 'male') AS kink"
    ).first()
    assert abs(r.p - 0.975) < 1e-6 and abs(r.up - 0.134) < 1e-3 and abs(r.down + 0.118) < 1e-3
    assert abs(r.egfr - 46.49) < 0.05 and math.isclose(r.kink, 142 * 0.9938**50)


def test_text_formats(spark):
    row = spark.range(1).select(
        iso_date(F.lit(951782400)).alias("leap"), iso_date(F.lit(-86400)).alias("before"),
        iso_instant(F.lit(1767657600 + 3661)).alias("instant"), value(F.lit(127.14)).alias("v0"),
        value(F.lit(12.345)).alias("v1"), value(F.lit(5.594)).alias("v2"), value(F.lit(0.125)).alias("tie"),
        signed_pct(F.lit(0.1234)).alias("up"), signed_pct(F.lit(-0.05)).alias("down"),
    ).first()
    assert tuple(row) == (
        "2000-02-29", "1969-12-31", "2026-01-06T01:01:01Z", "127", "12.3", "5.59", "0.12", "+12.3 %", "-5.0 %"
    )
