"""Micro-batches against one batch run over the same files."""

import json

from helpers import START, noise, weekly
from labtide.operators import reports, signals, tables
from labtide.streaming import uploads

HEADER = "patient_id,code,value,unit,taken_at,source\n"


def _csv(rows):
    return HEADER + "".join(f"{p},{c},{v!r},{u},{t:%Y-%m-%d},{s}\n" for p, c, v, u, t, s in rows)


def _patient(pid, gender, born):
    return json.dumps({"resourceType": "Patient", "id": pid, "gender": gender, "birthDate": born}) + "\n"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_uploads_are_idempotent_late_results_count_and_patients_are_corrected(spark, tmp_path):
    folder, store = tmp_path / "in", uploads.Store(str(tmp_path / "store"))
    folder.mkdir()
    run_csv = lambda: uploads.run_csv(spark, str(folder), store, str(tmp_path / "cp1")).awaitTermination()
    run_fhir = lambda: uploads.run_fhir(spark, str(folder), store, str(tmp_path / "cp2")).awaitTermination()

    series = weekly("a", "CREAT", [1.0 * w for w in noise(4, 14, 0.02)] + [1.7, 1.7], "mg/dL")
    late, on_time = series[4:6], series[:4] + series[6:]
    (folder / "1.csv").write_text(_csv(on_time))
    run_csv()
    assert tables.read_results(spark, store.results).count() == 14

    # the same file again, late results, another patient and a bad row
    other = weekly("b", "LDL", [120.0] * 5, "mg/dL")
    (folder / "2.csv").write_text(_csv(on_time + late + other))
    run_csv()
    assert tables.read_results(spark, store.results).count() == 21
    # a file with a bad row, and one whose columns are swapped, are refused whole
    (folder / "5.csv").write_text(_csv(weekly("c", "LDL", [120.0] * 3, "mg/dL")) + "c,LDL,,mg/dL,2026-01-01,test\n")
    (folder / "6.csv").write_text("patient_id,code,unit,value,taken_at,source\nd,LDL,101,100,2026-01-01,test\n")
    run_csv()
    assert tables.read_results(spark, store.results).count() == 21
    reasons = [r.reject_reason for r in spark.read.parquet(store.rejects).collect()]
    assert len(reasons) == 5 and sum("missing or null value" in r for r in reasons) == 4 and sum("schema mismatch" in r for r in reasons) == 1

    (folder / "3.ndjson").write_text(_patient("a", "female", "1960-02-03"))
    run_fhir()
    status = {(r.code, r.derived): r.status for r in uploads.current_status(spark, store).where("patient_id = 'a'").collect()}
    assert status.keys() == {("CREAT", False), ("EGFR", True)}

    observed = tables.read_results(spark, store.results)
    expected = reports.reports(observed, uploads.current_demographics(spark, store))
    columns = ["patient_id", "code", "derived", "rule", "severity", "t"]
    assert _rows(uploads.current_signals(spark, store).select(*columns)) == _rows(
        signals.explode_signals(expected).select(*columns)
    )
    assert series[0][4] == START

    # a corrected Patient without a birth date takes the derived series away
    (folder / "4.ndjson").write_text(_patient("a", "female", "unknown"))
    run_fhir()
    assert _rows(uploads.current_demographics(spark, store)) == [("a", "female", None)]
    left = uploads.current_status(spark, store).where("patient_id = 'a'").collect()
    assert [(r.code, r.derived) for r in left] == [("CREAT", False)]
