"""Series of any length: segments, pair counts and the segmented detectors against the short path."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DAY, START_T, demographics, noise, observations, theil_sen, weekly
from labtide.operators import layout, long_trend, normalise, points, reports
from labtide.operators.pair_counts import pair_counts, rising_weight, slopes_at_ranks, strict_pairs
from labtide.operators.segments import segmented, weighted_median, with_running
from labtide.options import Options


def brute(a, b, c):
    up = down = 0
    for i in range(len(a)):
        for j in range(len(a)):
            if a[i] < a[j]:
                up += c[i] * c[j] * (b[i] < b[j])
                down += c[i] * c[j] * (b[i] > b[j])
    return up, down


@pytest.mark.parametrize("seed", range(5))
def test_strict_pairs_equals_the_double_loop(seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, 60), rng.integers(0, 7, 60).astype(float), rng.integers(1, 5, 60)
    assert strict_pairs(a, b, c) == brute(a, b, c)


def test_rising_weight_edge_cases():
    assert rising_weight(np.array([]), np.array([], dtype=np.int64)) == 0
    assert rising_weight(np.array([3.0]), np.array([4])) == 0
    assert rising_weight(np.array([1.0, 1.0]), np.array([4, 2])) == 0
    assert rising_weight(np.array([1.0, 2.0]), np.array([4, 2])) == 8


@pytest.mark.parametrize("seed", range(4))
def test_slopes_at_ranks_are_the_sorted_slopes(seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, 90, 50)) * DAY
    v = np.round(5 + rng.normal(0, 1, 50), 1 if seed % 2 else 6)
    _, slopes = theil_sen(t, v)
    ranks = [1, len(slopes) // 3, len(slopes) // 2, len(slopes)]
    found = slopes_at_ranks((t - t[0]) / DAY, v, ranks)
    assert np.allclose(found, [slopes[r - 1] for r in ranks], rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def hot(spark):
    """Two long keys with repeated values, one value making up a third of the rows."""
    rows = []
    for key, seed in (("a", 1), ("b", 2)):
        rng = np.random.default_rng(seed)
        for i in range(240):
            w = 5.0 if rng.random() < 0.34 else round(float(rng.normal(5, 1)), 1)
            rows.append((key, "X", False, i, w))
    return rows, spark.createDataFrame(rows, "patient_id string, code string, derived boolean, pos long, w double")


def test_pair_counts_over_blocks_equal_the_double_loop(hot):
    rows, df = hot
    out = {r.patient_id: (r.rising, r.falling) for r in
           pair_counts(df, long_trend.KEYS, longest=240, rows=480, block_rows=50).collect()}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        assert out[key] == brute([r[3] for r in mine], [r[4] for r in mine], [1] * len(mine))


def test_running_sums_and_median_cross_segments(hot, spark):
    rows, df = hot
    seg = segmented(df, ["patient_id"], ["pos"], 480, segment_rows=60)
    assert seg.select("seg").distinct().count() > 3
    out = with_running(seg, ["patient_id"], ["pos"], F.lit(1)).collect()
    assert all(r.before == r.pos and r.total == 240 for r in out)
    counts = df.groupBy("patient_id", "w").agg(F.count(F.lit(1)).alias("c"))
    for r in weighted_median(counts, ["patient_id"], "w", 200, segment_rows=9).collect():
        assert r["median"] == np.median([x[4] for x in rows if x[0] == r.patient_id])


def _close(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-11)
    if isinstance(x, dict):
        return all(_close(x[k], y[k]) for k in x)
    if isinstance(x, list):
        return len(x) == len(y) and all(_close(a, b) for a, b in zip(x, y))
    return x == y


@pytest.fixture(scope="module")
def cohort(spark):
    rows = []
    for p, step in enumerate([1.0, 1.3, 0.75, 1.05]):
        wave = noise(p + 3, 40, 0.05)
        rows += weekly(f"p{p}", "CREAT", [0.95 * w * (step if i > 20 else 1) for i, w in enumerate(wave)], "mg/dL")
        rows += weekly(f"p{p}", "LDL", [3.1 * w for w in wave[:30]], "mmol/L")
        rows += weekly(f"p{p}", "ZZZ", [50 + i * step for i in range(25)], "U/L")
    rows += weekly("p0", "ZZZ", [3.0], "kU/L", first=30)
    rows += weekly("p1", "TSH", [2.0, 0.0, 2.1] * 5, "mIU/L")
    rows += weekly("p2", "HBA1C", [5.4] * 8, "mg/dL")
    people = [("p0", "female", 1960), ("p1", "male", None), ("p2", "other", 1950), ("p3", "male", 1955)]
    return observations(spark, rows), demographics(spark, people)


@pytest.mark.parametrize("as_of", [None, START_T + 180 * DAY])
def test_segmented_reports_equal_the_array_reports(cohort, as_of):
    obs, people = cohort
    options = Options(as_of=as_of, window_days=150)
    plan = dataclasses.replace(layout.measure(normalise.readings(obs), limit=6), segment_rows=60)
    assert plan.long_rows > 200
    key = lambda r: (r["patient_id"], r["code"], r["derived"])
    short = {key(r): r.asDict(True) for r in reports.reports(obs, people, options).drop("points").collect()}
    long = {key(r): r.asDict(True) for r in reports.reports(obs, people, options, plan).drop("points").collect()}
    assert short.keys() == long.keys()
    for k in short:
        different = [c for c in short[k] if not _close(short[k][c], long[k][c])]
        assert not different, (k, {c: (short[k][c], long[k][c]) for c in different})


def test_segmented_points_equal_the_array_points(cohort):
    obs, people = cohort
    plan = dataclasses.replace(layout.measure(normalise.readings(obs), limit=6), segment_rows=60)
    rows = lambda p: sorted(
        (tuple(r) for r in points.annotations(reports.all_points(obs, people, plan=p)).collect()), key=str
    )
    short, long = rows(None), rows(plan)
    assert len(short) == len(long)
    assert all(_close(list(a), list(b)) for a, b in zip(short, long))


def test_a_window_of_many_blocks_is_searched_in_rounds(spark):
    values = [5 + 0.01 * i + 0.4 * (w - 1) for i, w in enumerate(noise(9, 60, 1.0))]
    obs = observations(spark, weekly("h", "LDL", values, "mg/dL"))
    plan = dataclasses.replace(layout.measure(normalise.readings(obs), limit=6), block_rows=40)
    row = reports.facts(obs, None, Options(window_days=3650), plan).first()
    t = [START_T + i * 7 * DAY for i in range(len(values))]
    s, slopes = theil_sen(t, values)
    n = len(slopes)
    assert row.mk_s == s and row.sen_n == n
    assert math.isclose(row.sen_slope, (slopes[(n - 1) // 2] + slopes[n // 2]) / 2, rel_tol=1e-8)
    c = 1.959963985 * math.sqrt(row.mk_var)
    assert math.isclose(row.sen_low, slopes[round((n - c) / 2) - 1], rel_tol=1e-8)
    assert math.isclose(row.sen_high, slopes[round((n + c) / 2 + 1) - 1], rel_tol=1e-8)


def test_a_hot_patient_changes_the_partitioning_only(cohort):
    obs, people = cohort
    a = layout.measure(normalise.readings(obs))
    b = dataclasses.replace(a, by_patient=False)
    rows = lambda p: sorted(map(str, reports.reports(obs, people, plan=p).select("patient_id", "code", "signals").collect()))
    assert a.by_patient and rows(a) == rows(b)
