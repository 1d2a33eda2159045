"""Progressive nearest centroids and their rounds against a plain reading with Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from labtide.llm import centroids
from labtide.llm.common import settled

SCHEMA = "vec_id long, embedding array<double>, cluster string, id string, components string"


def _plain(rows, k=40, rounds=5):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    exact = [[math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v] for _, v in kept]
    key = lambda at: (hashlib.sha256(f"2:{'' if kept[at][0] is None else kept[at][0]}".encode()).hexdigest(), kept[at][0] is None, kept[at][0] or 0, kept[at][1])
    centres = [exact[at] for at in sorted(range(len(kept)), key=key)[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [min((distance(v, c), n) for n, c in enumerate(centres)) for v in exact]
        for n in range(len(centres) if turn < rounds else 0):
            members = [v for v, (_, m) in zip(exact, found) if m == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, n, d if d < 2**63 else None) for (i, _), (d, n) in zip(kept, found)), key=str), centres


def _run(spark, rows, k=40, rounds=5):
    df = spark.createDataFrame([(i, v, "c", "i", "v") for i, v in rows], SCHEMA).repartition(3)
    kept = centroids.kept(df)
    fitted = centroids.fit(kept, k, rounds)
    assigned = settled(centroids.assign(kept, fitted))
    return sorted(((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=str), fitted, centroids.with_inertia(assigned)


def _vectors(seed, n, spread=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(0, spread, (6, 64))
    return [(i, (middle[i % 6] + r.normal(0, 0.1, 64)).tolist()) for i in range(n)]


def test_odd_vectors_and_ties(spark):
    rows = _vectors(1, 120)
    common = rows[0][1]
    rows += [(200 + i, common) for i in range(60)]  # a third of all rows are one vector
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, common), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, common[:63]), (303, [*common, 0.0]), (304, [*common[:63], None])]
    rows += [(305, [*common[:63], math.nan]), (306, [math.inf, *common[1:]]), (307, [-0.0] * 64), (308, [-1e-9] * 64)]
    found, fitted, _ = _run(spark, rows)
    want, centres = _plain(rows)
    assert found == want and fitted == centres


def test_sums_by_cluster_and_over_all(spark):
    found, fitted, inertia = _run(spark, _vectors(2, 90), k=5, rounds=2)
    assert (found, fitted) == _plain(_vectors(2, 90), k=5, rounds=2)
    by = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in inertia.collect()} == {(c, s, sum(by.values())) for c, s in by.items()}


def test_values_beyond_64_bits_stay_exact(spark):
    rows = _vectors(3, 30) + [(100, [1e30] * 64), (101, [1e30] * 63 + [-1e308]), (102, [7e4] * 64), (103, [3.5e9, *[1.0] * 63])]
    found, fitted, inertia = _run(spark, rows, k=2, rounds=3)
    assert (found, fitted) == _plain(rows, k=2, rounds=3)
    assert any(d is None for *_, d in found) and {r.inertia for r in inertia.collect()} == {None}


def test_few_vectors_and_none(spark):
    rows = _vectors(4, 3)
    assert _run(spark, rows)[:2] == _plain(rows)
    found, fitted, inertia = _run(spark, [(1, None), (2, [1.0])])
    assert found == [] and fitted == [] and inertia.collect() == []


@pytest.mark.parametrize("dims, k", [(64, 40), (64, 1), (8, 5), (1, 3)])
def test_search_equals_all_distances(dims, k):
    r = np.random.default_rng(dims + k)
    points, centres = r.integers(-400, 400, (300, dims)), r.integers(-400, 400, (k, dims))
    centres[-1] = centres[0]
    points[0] = centres[0]
    order = centroids.sequency_order(dims)
    number, whole = centroids.nearest(centroids.transformed(points, order), centroids.transformed(centres, order))
    every = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (whole == dims * every.min(axis=1)).all()


def test_coefficients_run_from_coarse_to_fine():
    rows = centroids.transformed(np.eye(64, dtype=np.int64), centroids.sequency_order(64)).T
    assert (rows @ rows.T == 64 * np.eye(64)).all()
    assert [int((np.diff(row) != 0).sum()) for row in rows] == list(range(64))
