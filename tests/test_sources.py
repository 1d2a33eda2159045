"""CSV, FHIR and landing folders."""

import json
from datetime import datetime

import pytest

from labtide.operators import tables
from labtide.options import Options
from labtide.sources import csv, fhir, landing, records

HEADER = "patient_id,code,value,unit,taken_at,source\n"
GOOD = (
    "alice,hba1c,5.7,%,2026-01-15,labs\n alice ,LDL,120,mg/dL,2026-01-15 07:05:00,labs\n"
    "bob,3016-3,2.1,mIU/L,2026-02-01T08:30:00,labs\n"
)
UCUM, LOINC = fhir.UCUM, fhir.LOINC


def test_csv_rows_are_typed_trimmed_and_mapped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + HEADER.upper() + GOOD)
    accepted, rejected = csv.read_csv(spark, str(tmp_path / "a.csv"))
    rows = {(r.patient_id, r.code): r for r in accepted.collect()}
    assert rows.keys() == {("alice", "HBA1C"), ("alice", "LDL"), ("bob", "TSH")}
    assert rows[("bob", "TSH")].taken_at == datetime(2026, 2, 1, 8, 30)
    assert rows[("alice", "LDL")].taken_at == datetime(2026, 1, 15, 7, 5)
    assert rejected.count() == 0


@pytest.mark.parametrize("header", ["patient_id,value\n", "code,patient_id,value,unit,taken_at,source\n", "\n"])
def test_a_wrong_header_names_expected_and_actual(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(header + GOOD)
    with pytest.raises(ValueError, match="schema mismatch.*patient_id, code, value"):
        csv.read_csv(spark, str(tmp_path / "a.csv"))


def test_bad_rows_carry_their_reason_and_stop_a_strict_upload(spark, tmp_path):
    bad = (
        "bob,HBA1C,,%,2026-01-15,labs\nbob,HBA1C,high,%,2026-01-15,labs\nbob,HBA1C,NaN,%,2026-01-15,labs\n"
        ",HBA1C,5,%,2026-01-15,labs\nbob,,5,%,2026-01-15,labs\nbob,HBA1C,5,,2026-01-15,labs\n"
        "bob,HBA1C,5,%,,labs\nbob,HBA1C,5,%,not-a-date,labs\nbob,HBA1C,5,%,2026-13-01,labs\n"
        "bob,HBA1C,5,%,2026-01-15T00:00:00Z,labs\nbob,HBA1C,5,%,2026-01-15,\n"
    )
    (tmp_path / "a.csv").write_text(HEADER + GOOD + bad)
    accepted, rejected = csv.read_csv(spark, str(tmp_path / "a.csv"), strict=False)
    assert accepted.count() == 3
    assert [r.reject_reason for r in rejected.orderBy("seq").collect()] == [
        "missing or null value", "value is not a number", "non-finite value", "missing or null patient_id",
        "missing or null code", "missing or null unit", "missing or null taken_at", "invalid taken_at: not-a-date",
        "invalid taken_at: 2026-13-01", "invalid taken_at: 2026-01-15T00:00:00Z", "missing or null source",
    ]
    with pytest.raises(ValueError, match="missing or null value"):
        csv.read_csv(spark, str(tmp_path / "a.csv"))


def lab(number, **fields):
    """A usable result of person ``number``; a field given as ... is left out."""
    whole = {
        "resourceType": "Observation",
        "id": f"res-{number}",
        "status": "amended",
        "code": {"text": "TSH", "coding": [{"system": LOINC, "code": "11580-8", "display": "TSH"}]},
        "subject": {"reference": f"Patient/k{number:03}"},
        "effectiveDateTime": "2024-11-05T18:45:10-05:00",
        "valueQuantity": {"value": 2.75, "unit": "mIU per litre", "system": UCUM, "code": "m[IU]/L"},
    }
    return {k: v for k, v in (whole | fields).items() if v is not ...}


def as_bundle(resources):
    return json.dumps({"resourceType": "Bundle", "type": "collection", "entry": [{"resource": r} for r in resources]})


def put(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder)


def test_results_carry_their_instant_and_the_coded_unit(spark, tmp_path):
    put(tmp_path, "many.json", as_bundle([lab(1), lab(2, effectiveDateTime="2024-11-05")]))
    put(tmp_path, "single.json", lab(3, subject={"reference": "urn:uuid:77-x"}, valueQuantity={"value": 3, "unit": "mU/L", "code": "free"}))
    accepted, skipped, _ = fhir.read_fhir(spark, str(tmp_path))
    found = {r.patient_id: (r.code, r.value, r.unit, r.taken_at) for r in accepted.collect()}
    assert found == {
        "k001": ("TSH", 2.75, "m[IU]/L", datetime(2024, 11, 5, 23, 45, 10)),
        "k002": ("TSH", 2.75, "m[IU]/L", datetime(2024, 11, 5)),
        "77-x": ("TSH", 3.0, "mU/L", datetime(2024, 11, 5, 23, 45, 10)),
    }
    assert skipped.count() == 0


def _coded(*codings):
    return {"code": {"coding": list(codings)}}


DEFECTS = {
    "status cancelled": [{"status": "cancelled"}],
    "no LOINC coding": [_coded({"system": "urn:local", "code": "tsh"}), _coded(), {"code": {"text": "only words"}}],
    "no valueQuantity": [{"valueQuantity": ...}],
    "without a value": [{"valueQuantity": {"code": "m[IU]/L", "system": UCUM}}],
    "without a unit": [{"valueQuantity": {"value": 0.4}}, {"valueQuantity": {"value": 0.4, "unit": "\t"}}],
    "no effectiveDateTime": [{"effectiveDateTime": ...}],
    "not a full date": [{"effectiveDateTime": "2024"}, {"effectiveDateTime": "2024-11-05T18:45:10"}],
    "no subject reference": [{"subject": {"display": "somebody"}}],
    "is not a Patient": [{"subject": {"reference": "Device/scale-4"}}],
    "not a valid Observation": [
        {"status": ["final"]}, {"code": "11580-8"}, {"subject": "k9"}, {"valueQuantity": {"value": True, "unit": "mU/L"}},
    ],
    "no analyte profile for LOINC 777-3": [_coded({"system": LOINC, "code": "777-3"})],
}


def test_each_defect_has_its_reason_and_costs_only_its_own_result(spark, tmp_path):
    cases = [(reason, defect) for reason, defects in DEFECTS.items() for defect in defects]
    resources = [lab(i, **defect) for i, (_, defect) in enumerate(cases)] + [lab(500)]
    accepted, skipped, _ = fhir.read_fhir(spark, put(tmp_path, "defects.json", as_bundle(resources)))
    assert [r.patient_id for r in accepted.collect()] == ["k500"]
    given = {r.resource: r.reason for r in skipped.collect()}
    for i, (reason, defect) in enumerate(cases):
        assert reason in given[f"Observation/res-{i}"], (defect, given[f"Observation/res-{i}"])
    first = tables.skip_histogram(skipped).first()
    assert (first.reason, first.n) == ("not a valid Observation", 4)


def _person(key, **fields):
    return {"resourceType": "Patient", "id": key, "name": [{"family": "Never"}], **fields}


def test_persons_give_legal_gender_and_plausible_birth_year(spark, tmp_path):
    persons = [
        _person("u", gender="unknown", birthDate="2001-12"), _person("v", gender="other"), _person("w", gender="F", birthDate="next year"),
        _person("x", gender="female", birthDate="2150-01-01"), {"resourceType": "Patient", "gender": "other"}, {"resourceType": "Encounter", "id": "y"},
    ]
    _, skipped, found = fhir.read_fhir(spark, put(tmp_path, "persons.json", as_bundle(persons)))
    rows = {r.patient_id: (r.gender, r.birth_year) for r in found.collect()}
    assert rows == {"u": ("unknown", 2001), "v": ("other", None), "w": (None, None), "x": ("female", None)}
    assert skipped.count() == 0
    # the reader's own frame feeds the demographics table
    stored = spark.createDataFrame([("u", "male", 1950), ("z", "male", 1951)], "patient_id string, gender string, birth_year int")
    merged = {r.patient_id: (r.gender, r.birth_year) for r in tables.upsert_demographics(stored, found).collect()}
    assert merged == rows | {"z": ("male", 1951)}


@pytest.mark.parametrize("content", ["[1, 2", '{"resourceType": "Medication"}', '{"type": "collection", "entry": []}'])
def test_a_document_of_another_kind_is_an_error(spark, tmp_path, content):
    with pytest.raises(ValueError):
        fhir.read_fhir(spark, put(tmp_path, "other.json", content))


def test_bulk_lines_are_resources(spark, tmp_path):
    put(tmp_path, "bulk.ndjson", "\n\n".join(json.dumps(lab(i)) for i in range(7)) + "\n \t\n")
    accepted, skipped, _ = fhir.read_ndjson(spark, str(tmp_path))
    assert sorted(r.patient_id for r in accepted.collect()) == [f"k00{i}" for i in range(7)] and skipped.count() == 0


def test_a_row_with_too_many_or_too_few_fields_is_rejected(spark, tmp_path):
    put(tmp_path, "a.csv", HEADER + GOOD + "bob,LDL,90,mg/dL,2026-03-01,labs,more\nbob,LDL,91,mg/dL,2026-03-02\n")
    accepted, rejected = csv.read_csv(spark, str(tmp_path / "a.csv"), strict=False)
    assert accepted.count() == 3 and {r.reject_reason for r in rejected.collect()} == {"not 6 fields"} and rejected.count() == 2


def test_a_quoted_line_break_stays_in_its_field(spark, tmp_path):
    put(tmp_path, "a.csv", HEADER + 'bob,LDL,90,mg/dL,2026-03-01,"ward 3\nbed 2"\nbob,LDL,91,mg/dL,2026-03-02,labs\n')
    accepted, rejected = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(r.source for r in accepted.collect()) == ["labs", "ward 3\nbed 2"] and rejected.count() == 0


def test_white_space_of_any_script_is_trimmed(spark, tmp_path):
    put(tmp_path, "a.csv", HEADER + "\u00a0bob\t, ldl\u2003,\t90 ,mg/dL\t,2026-03-01\u00a0,labs\n")
    row = csv.read_csv(spark, str(tmp_path / "a.csv"))[0].first()
    assert (row.patient_id, row.code, row.value, row.unit, row.source) == ("bob", "LDL", 90.0, "mg/dL", "labs")


def test_a_document_after_blank_lines_is_still_json(spark, tmp_path):
    put(tmp_path, "a.json", "\t\n\u00a0\n " + as_bundle([lab(1)]))
    assert [r.format for r in landing.file_formats(spark, str(tmp_path)).collect()] == ["fhir"]


def test_a_landing_folder_skips_failing_files_and_loads_the_rest(spark, tmp_path):
    (tmp_path / "1.csv").write_text(HEADER + GOOD)
    (tmp_path / "2.csv").write_text("patient_id,value\na,1\n")
    (tmp_path / "3.csv").write_text(HEADER + GOOD + "bob,LDL,,mg/dL,2026-01-15,labs\n")
    (tmp_path / "4.json").write_text(as_bundle([lab(1), lab(2, status="unknown")]))
    (tmp_path / "5.json").write_text("{}")
    (tmp_path / "6.txt").write_text("ignored")
    obs, skipped, patients, failed = landing.load(spark, str(tmp_path))
    assert obs.count() == 4 and skipped.count() == 1 and patients.count() == 0
    names = {r.file.rsplit("/", 1)[1]: r.error for r in failed.collect()}
    assert names.keys() == {"2.csv", "3.csv", "5.json"}
    assert "schema mismatch" in names["2.csv"] and "missing or null value" in names["3.csv"]
    formats = {r.file.rsplit("/", 1)[1]: r.format for r in landing.file_formats(spark, str(tmp_path)).collect()}
    assert formats["1.csv"] == "csv" and formats["4.json"] == "fhir"


def test_the_first_file_by_name_wins(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "a,LDL,2,mg/dL,2026-01-15,second\n")
    (tmp_path / "a.csv").write_text(HEADER + "a,LDL,1,mg/dL,2026-01-15,first\na,LDL,9,mg/dL,2026-01-15,again\n")
    obs, _, _, _ = landing.load(spark, str(tmp_path))
    stored = tables.read_results(spark, str(tmp_path / "none"))
    rows = tables.new_results(obs, stored).collect()
    assert [(r.value, r.source) for r in rows] == [(1.0, "first")]


def test_uploading_twice_inserts_nothing_new(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + GOOD + GOOD)
    accepted, _ = csv.read_csv(spark, str(tmp_path / "a.csv"))
    path = str(tmp_path / "results")
    for expected in ((6, 3, 3), (6, 0, 6)):
        fresh = tables.new_results(accepted, tables.read_results(spark, path))
        r = tables.insert_counts(accepted, fresh).first()
        assert (r.submitted, r.inserted, r.duplicates) == expected
        tables.append_results(spark, path, accepted)
    assert tables.read_results(spark, path).count() == 3


def test_options_are_validated():
    for w in ("1", "abc", "99999"):
        with pytest.raises(ValueError):
            Options.parse(window_days=w)
    with pytest.raises(ValueError):
        Options.parse(as_of="yesterday")
    assert Options.parse("2026-01-02", "").as_of == 1767398399
    assert Options.parse("2026-01-02T12:00:00Z", "90") == Options(1767355200, 90)
    assert Options.parse("2026-01-02T12:00:00+02:00").as_of == 1767348000
    assert Options.parse().window_days == 1095 and Options.parse().as_of is None


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_and_rows_are_not_dealt_by_file(spark, tmp_path):
    entries = spark.range(1000).selectExpr("IF(id < 0, 'none', 'one') AS file", "id AS position", "'{\"resource\": {\"id\": \"a\"}}' AS value")
    skeletons = spark.createDataFrame([("one", '{"resourceType": "Bundle"}', True)], "file string, value string, sound boolean")
    errors = spark.createDataFrame([], "file string, error string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fhir.resources(skeletons, entries, errors)
        assert found.count() == 1000
        joins = [line for line in _executed(found).splitlines() if "Join" in line and "LeftSemi" in line]
        assert joins and all("BroadcastHashJoin" in line for line in joins)
        # more files than are sent to the tasks: rows of one file are met by their parts
        files = spark.createDataFrame([("one",)], "file string")
        other = entries.unionByName(entries.selectExpr("'two' AS file", "position", "value"))
        for how, count in (("left_semi", 1000), ("left_anti", 1000), ("left", 2000)):
            assert records.with_files(other, files, how, most=0).count() == count
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_upload_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + GOOD)
    accepted, _ = csv.read_csv(spark, str(tmp_path))
    assert "MapInArrow" not in _executed(accepted)
