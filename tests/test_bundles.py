"""FHIR documents cut out of blocks, however small, against Python's own parser."""

import json
import random

import pytest

from labtide.sources import bundles, fhir

BLOCK = "spark.sql.files.maxPartitionBytes"
TEXTS = ["x", "}", "{", "]}[", '"', '\\"', "\\", "}\\", "é漢", "\n", '"entry": [', "a, b", "}}}}" * 5]


@pytest.fixture(params=[61, 1 << 27])
def block(request, spark):
    before = {name: spark.conf.get(name) for name in (BLOCK, "spark.sql.files.openCostInBytes")}
    for name in before:
        spark.conf.set(name, request.param)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def _value(r, depth=0):
    kind = r.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(r.choice(TEXTS) for _ in range(r.randint(0, 4)))
    if kind == 2:
        return r.choice([None, True, 0, -1.5, 100])
    if kind == 3:
        return []
    if kind == 4:
        return [_value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["entry", "resource", "a", "b}", 'c"']) + str(i): _value(r, depth + 1) for i in range(r.randint(0, 3))}


def _bundle(seed):
    r = random.Random(seed)
    entry = [{"resource": {"resourceType": "Observation", "n": i, "v": _value(r)}, "x": _value(r)} for i in range(r.randint(0, 25))]
    for extra in ({"fullUrl": "no resource"}, 7, "text }", None, [{"resource": {"n": 1}}], {"resource": None}):
        if r.random() < 0.4:
            entry.insert(r.randint(0, len(entry)), extra)
    doc = {"id": "entry", "meta": {"entry": [{"resource": {"n": -1}}]}, "link": [{"resource": {"n": -2}}, _value(r)]}
    items = list({**doc, "resourceType": "Bundle", "entry": entry, "after": [{"entry": [{"resource": {}}]}]}.items())
    r.shuffle(items)
    doc = dict(items)
    text = json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
    return r.choice(["", "﻿"]) + text + r.choice(["", "\n", " \r\n"]), [e["resource"] for e in entry if isinstance(e, dict) and e.get("resource") is not None]


def _loaded(spark, folder):
    skeletons, entries = bundles.load(spark.read, str(folder))
    errors = fhir.document_errors(skeletons, entries)
    rows = fhir.resources(skeletons, entries, errors).selectExpr("file", "position", "to_json(resource) AS body").orderBy("file", "position").collect()
    out = {}
    for row in rows:
        out.setdefault(row.file.rsplit("/")[-1], []).append(json.loads(row.body))
    return out, {r.file.rsplit("/")[-1]: r.error for r in errors.collect()}


def test_entries_of_many_documents(spark, tmp_path, block):
    want = {}
    for seed in range(14):
        text, resources = _bundle(seed)
        (tmp_path / f"{seed:02}.json").write_text(text, encoding="utf-8", newline="")
        if resources:
            want[f"{seed:02}.json"] = resources
    found, errors = _loaded(spark, tmp_path)
    assert errors == {} and found == want


def test_faulty_documents(spark, tmp_path, block):
    good = json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"id": i, "t": "x" * 40}} for i in range(6)]})
    cases = {
        "cut": (good[:-40], "invalid JSON"), "more": (good + "}", "invalid JSON"), "text_behind": (good + " x", "invalid JSON"),
        "comma": (good.replace("}}, {", "}} {", 1), "invalid JSON"), "two_commas": (good.replace("}}, {", "}},, {", 1), "invalid JSON"),
        "entry": (good.replace('"id": 3', '"id": three'), "invalid JSON"), "none": ('{"entry": [{"resource": {}}]}', "missing resourceType"),
        "kind": ('{"resourceType": "Patient"}', "expected a Bundle or an Observation, got Patient"), "blank": ("\n", "invalid JSON"),
        "object": ('{"resourceType": "Bundle", "entry": {"resource": {"id": 1}}}', "invalid Bundle"), "list": ("[" + good + "]", "missing resourceType"),
        "open_text": (good.replace('"id": 2', '"id: 2'), "invalid JSON"), "good": (good, None), "no_entry": ('{"resourceType": "Bundle"}', None),
        "null_entry": ('{"resourceType": "Bundle", "entry": null}', None), "single": ('{"resourceType": "Observation", "n": [0,0,{"a":[0,0]}]}\n', None),
    }
    for name, (text, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    found, errors = _loaded(spark, tmp_path)
    expected = {f"{name}.json": error for name, (_, error) in cases.items() if error}
    if "null_entry.json" in errors:  # as a value that is no list
        expected["null_entry.json"] = "invalid Bundle"
    assert errors == expected
    assert [r["id"] for r in found["good.json"]] == list(range(6)) and found["single.json"] == [{"resourceType": "Observation", "n": [0, 0, {"a": [0, 0]}]}]
    assert found.keys() == {"good.json", "single.json"}


def test_a_document_is_read_by_many_tasks(spark, tmp_path, block):
    entry = [{"resource": {"resourceType": "Observation", "id": str(i)}} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps({"resourceType": "Bundle", "entry": entry}))
    starts = bundles.starts(spark.read, str(tmp_path))
    skeletons, entries = bundles.load(spark.read, str(tmp_path))
    assert entries.count() == 300 and len(skeletons.first().value) < 60
    assert starts.count() > 100 if block < 1000 else starts.count() == 1


def test_an_entry_beyond_any_size_is_refused(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(bundles, "LONGEST", 200)
    for name, size in (("long", 400), ("short", 20)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"t": "}" * size}}]}))
    found, errors = _loaded(spark, tmp_path)
    assert errors == {"long.json": "invalid JSON"} and found.keys() == {"short.json"}
