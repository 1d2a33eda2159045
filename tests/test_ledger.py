"""The stored tables: pruned inserts, writers at the same time, replays, merging."""

import json
import threading
from datetime import timedelta

import pytest

from helpers import START, observations
from labtide.operators import tables
from labtide.operators.ledger import Ledger
from labtide.schemas import OBSERVATIONS

KEY = tables.RESULT_KEY


def _rows(people, days, value=1.0):
    return [(f"p{p:03}", "LDL", value, "mg/dL", START + timedelta(days=d), "test") for p in people for d in days]


def _ledger(spark, path, buckets=16):
    return Ledger(spark, str(path / "store"), KEY, OBSERVATIONS, time="taken_at", buckets=buckets)


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _stored(ledger):
    return sorted((r.patient_id, (r.taken_at.replace(tzinfo=None) - START.replace(tzinfo=None)).days, r.value) for r in ledger.read().collect())


def test_first_value_of_a_key_stays(spark, tmp_path):
    ledger = _ledger(spark, tmp_path)
    assert ledger.read().collect() == [] and ledger.current().number == 0
    assert ledger.insert(observations(spark, _rows(range(30), [0, 1]))).inserted == 60
    done = ledger.insert(observations(spark, _rows(range(20, 40), [1, 2], value=9.0)))
    assert (done.submitted, done.inserted, done.duplicates) == (40, 30, 10)
    assert _stored(ledger) == sorted(
        [(f"p{p:03}", d, 1.0) for p in range(30) for d in (0, 1)]
        + [(f"p{p:03}", d, 9.0) for p in range(20, 40) for d in (1, 2) if (p, d) not in {(q, 1) for q in range(20, 30)}]
    )
    assert ledger.insert(observations(spark, [])).inserted == 0 and len(ledger.current().generations) == 2


def test_an_insert_exchanges_the_batch_only_and_opens_its_buckets(spark, tmp_path):
    ledger = _ledger(spark, tmp_path)
    ledger.insert(observations(spark, _rows(range(300), [0, 1])))
    plan = _plan(ledger.beside(observations(spark, _rows([3, 4], [1, 2])), ledger.current().generations))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "SelectedBucketsCount: 2 out of 16" in plan and "ReadSchema: struct<patient_id:string,code:string,taken_at:timestamp>" in plan
    # patients or times that no file can hold: the store is not read
    for rows in (_rows([3], [400]), [("zed", "LDL", 1.0, "mg/dL", START, "test")]):
        assert "labtide_" not in _plan(ledger.beside(observations(spark, rows), ledger.current().generations))


def test_many_patients_join_beside_all_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("labtide.operators.ledger.NAMED", 5)
    ledger = _ledger(spark, tmp_path)
    ledger.insert(observations(spark, _rows(range(50), [0])))
    batch = observations(spark, _rows(range(30, 60), [0, 1]))
    tree = _plan(ledger.beside(batch, ledger.current().generations)).split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert ledger.of_patients(batch).count() == 20 and ledger.insert(batch).inserted == 40


def test_only_the_buckets_of_touched_patients_are_read(spark, tmp_path):
    ledger = _ledger(spark, tmp_path)
    for days in ([0, 1], [2]):
        ledger.insert(observations(spark, _rows(range(200), days)))
    touched = observations(spark, _rows([7, 8], [5]))
    found = ledger.of_patients(touched)
    assert found.count() == 6 and len(found.inputFiles()) == 4 < len(ledger.read().inputFiles()) == 32
    assert ledger.of_patients(observations(spark, [])).collect() == []


def test_writers_at_the_same_time_store_a_key_once(spark, tmp_path):
    done, faults = {}, []

    def write(feed):
        try:
            ledger = _ledger(spark, tmp_path)
            done[feed] = ledger.insert(observations(spark, _rows(range(feed, feed + 40), [0, 1], value=float(feed))), f"feed{feed}", 0)
        except Exception as fault:  # noqa: BLE001
            faults.append(fault)

    writers = [threading.Thread(target=write, args=(feed,)) for feed in (0, 10, 20)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not faults
    ledger = _ledger(spark, tmp_path)
    keys = [(p, d) for p, d, _ in _stored(ledger)]
    assert len(keys) == len(set(keys)) == 120 == sum(c.inserted for c in done.values())
    assert ledger.current().feeds == {"feed0": 0, "feed10": 0, "feed20": 0}


def test_a_manifest_number_is_given_once(spark, tmp_path):
    one, two = _ledger(spark, tmp_path), _ledger(spark, tmp_path)
    from labtide.operators.ledger import Manifest

    assert one._publish(Manifest(1, [], {"a": 1})) and not two._publish(Manifest(1, [], {"b": 1}))
    assert two.current().feeds == {"a": 1}
    assert json.loads((tmp_path / "store/log/00000000000000000001.json").read_text())["number"] == 1


def test_a_replayed_batch_counts_once(spark, tmp_path):
    ledger, rows = _ledger(spark, tmp_path), observations(spark, _rows(range(5), [0]))
    assert ledger.insert(rows, "csv", 4).inserted == 5
    again = ledger.insert(observations(spark, _rows(range(9), [0])), "csv", 4)
    assert again.replayed and again.inserted == 0 and len(_stored(ledger)) == 5
    assert ledger.insert(observations(spark, _rows(range(9), [0])), "csv", 5).inserted == 4


def test_generations_are_merged_and_old_files_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("labtide.operators.ledger.MOST_GENERATIONS", 3)
    ledger = _ledger(spark, tmp_path)
    for day in range(5):
        ledger.insert(observations(spark, _rows(range(10), [day])), "csv", day)
    assert len(ledger.current().generations) <= 3 and len(_stored(ledger)) == 50 == ledger.current().rows
    assert ledger.vacuum() > 0 and len(_stored(ledger)) == 50 and ledger.current().feeds == {"csv": 4}
    assert ledger.insert(observations(spark, _rows(range(10), [0, 9]))).inserted == 10


def test_demographics_keep_the_last_row_of_the_last_batch(spark, tmp_path):
    path = str(tmp_path / "people")
    assert tables.read_demographics(spark, path).collect() == []
    kind = "patient_id string, gender string, birth_year int, seq long"
    tables.append_demographics(spark, path, spark.createDataFrame([("a", "male", 1950, 1), ("a", "female", 1960, 2), ("b", "male", 1970, 1)], kind), feed="f", number=0)
    tables.append_demographics(spark, path, spark.createDataFrame([("a", None, None, 1), ("c", "other", 1980, 1)], kind), feed="f", number=1)
    tables.append_demographics(spark, path, spark.createDataFrame([("a", "male", 1, 1)], kind), feed="f", number=1)
    expected = [("a", None, None), ("b", "male", 1970), ("c", "other", 1980)]
    assert sorted(tuple(r) for r in tables.read_demographics(spark, path).collect()) == expected
    tables.demographics_ledger(spark, path).compact()
    assert sorted(tuple(r) for r in tables.read_demographics(spark, path).collect()) == expected
    assert tables.demographics_ledger(spark, path).read().count() == 3


@pytest.mark.parametrize("rows", [[], _rows([1], [0])])
def test_another_session_reads_the_store(spark, tmp_path, rows):
    _ledger(spark, tmp_path).insert(observations(spark, rows))
    other = spark.newSession()
    assert _ledger(other, tmp_path).read().count() == len(rows)


def test_of_rows_with_one_key_and_place_the_least_stays_in_any_order(spark):
    rows = [("p1", "LDL", v, "mg/dL", START, "test") for v in (3.0, 1.0, 2.0)]
    for order in (rows, rows[::-1]):
        batch = observations(spark, order).coalesce(1).selectExpr("*", "0 AS seq")
        assert [r.value for r in tables.first_wins(batch, "seq").collect()] == [1.0]
