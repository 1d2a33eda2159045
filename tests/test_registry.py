"""Every registered query against its SQL statement on the small driver tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from labtide.plans import oracle
from labtide.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
WITHOUT_SQL = {
    "signal_explanations", "drift_reports", "review_snapshots", "explain_context", "stub_drafts", "draft_audit"
}


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return [str(round(x, 4)) if isinstance(x, float) else str(x) for x in row]


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-9)
    return a == b


def test_only_text_and_nested_results_have_no_sql():
    assert QUERIES.keys() - oracle.QUERIES.keys() == WITHOUT_SQL
    assert QUERIES.keys() <= contract.queries().keys() and oracle.QUERIES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_equals_its_sql(spark, other_engine, name):
    df = QUERIES[name](spark, SF)
    result = other_engine.sql(oracle.QUERIES[name])
    names = sorted(result.columns)
    assert sorted(df.columns) == names
    mine = sorted(([r[c] for c in names] for r in df.collect()), key=_key)
    theirs = sorted(([r[result.columns.index(c)] for c in names] for r in result.fetchall()), key=_key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_text_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 0 and rows[0].status == "alert"


def test_draft_audit_computes_the_reports_once(spark):
    plan = contract.queries()["draft_audit"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
