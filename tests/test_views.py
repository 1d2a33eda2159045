"""Read views and the report sink."""

import json

from helpers import START_T, WEEK, demographics, noise, observations, weekly
from labtide.operators import reports, views
from labtide.schemas import REVIEW_EVENTS


def test_cohort_patient_and_series_views(spark, tmp_path):
    rows = weekly("a", "CREAT", [1.0 * w for w in noise(4, 12, 0.02)] + [1.6], "mg/dL")
    rows += weekly("b", "HBA1C", [5.4] * 5, "%")
    obs, people = observations(spark, rows), demographics(spark, [("a", "male", 1960)])
    last = START_T + 12 * WEEK
    log = spark.createDataFrame(
        [(i, "a", "CREAT", "rcv", last, "annotate", "repeat soon", "x", "{}", i) for i in (1, 2)], REVIEW_EVENTS
    )
    listed = views.cohort(obs, people, log).collect()
    assert [(r.patient_id, r.biomarkers, r.observations) for r in listed] == [("a", 1, 13), ("b", 1, 5)]

    one = views.patient(obs, people, log, "a")
    assert {(r.code, r.derived) for r in one["reports"].collect()} == {("CREAT", False), ("EGFR", True)}
    assert one["derived"].first().method.startswith("CKD-EPI 2021")

    creat = views.series(obs, people, log, "a", "creat")
    assert creat["points"].count() == 13 and creat["report"].count() == 1
    assert creat["observations"].first().taken_at == "2025-01-01T00:00:00Z"
    assert [r.id for r in creat["history"].collect()] == [2, 1]
    assert {r.rule: r.notes for r in creat["reviews"].collect()}["rcv"] == 2
    egfr = views.series(obs, people, log, "a", "EGFR")
    assert egfr["report"].first().code == "EGFR" and egfr["observations"].first().code == "CREAT"

    computed = reports.reports(obs, people)
    bodies = {(r.patient_id, r.code): json.loads(r.report) for r in views.as_json(reports.nested(computed)).collect()}
    assert bodies[("a", "CREAT")]["status"] == "alert" and bodies[("a", "CREAT")]["baseline"]["n"] == 10
    assert bodies[("b", "HBA1C")]["change_point"] is None and "patient_id" not in bodies[("b", "HBA1C")]
    views.write_reports(computed, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).where("code = 'EGFR'").count() == 1
