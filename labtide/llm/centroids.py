"""Centroid clustering: nearest centroids by a progressive Walsh-Hadamard search, on exact integers.

A component x becomes the integer floor(256 * x). The unnormalised Walsh-Hadamard transform keeps all distances
up to the factor `dims`, and its coefficients, ordered by their number of sign changes, describe a vector from
coarse to fine. Squared coefficient differences are added up level by level (1, 2, 4, ... coefficients). A sum over
some of them never exceeds the whole, so at each level a centroid falls out if its sum so far is strictly
above the whole distance of the centroid that leads. The others run through all coefficients; of those that end with the
same distance the smaller number wins. Everything is an integer, so neither the transform nor the order of
additions changes a result.

A round is one pass over the vectors. Each task returns its count and component sums per centroid, which are added up
before and after the shuffle by centroid, so the driver receives `k` centroids and nothing that grows with the
rows; a common vector costs no more than any other. Centroids travel inside the task. No round
writes anything: a lost executor's tasks read their part of the table again.

Defined cases: vectors that are null or empty, have another number of components, or hold a null, NaN or infinite one
are left out. A null id counts as the empty text in the choice of the first centroids and is kept; repeated
rows are vectors of their own (equal ones may start as several centroids, then the smallest number takes them all).
Fewer than `k` vectors give as many centroids; none give an empty result. Values up to 2**16 are
computed in 64-bit integers, greater ones in Python's; a distance or sum beyond 64 bits is null.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 40
DIMS = 64
ROUNDS = 5
SEED = "2"
SCALE = 256
#: Greatest magnitude of a component for 64-bit arithmetic: dims * dims * (2 * 2**24)**2 stays below 2**63.
_SAFE = 1 << 24
#: Pairs of vector and centroid looked at together in a task.
_PAIRS = 100_000
_LIMB = 32


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS) -> DataFrame:
    """id and components (as doubles) of the vectors with `dims` finite components."""
    finite = F.forall("components", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("components"))
    return rows.where((F.size("components") == dims) & finite)


def sequency_order(dims: int) -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    h = np.ones((1, 1), np.int8)
    while len(h) < dims:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


def transformed(vectors: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors (rows), coarse to fine."""
    n, dims = vectors.shape
    step, out = 1, vectors
    while step < dims:
        pairs = out.reshape(n, dims // (2 * step), 2, step)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([left + right, left - right], axis=2).reshape(n, dims)
        step *= 2
    return out[:, order]


def _row_starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(rows, prepend=-1))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and `dims` times the squared distance, for every point; both are coefficients."""
    n, dims = points.shape
    row, col = np.repeat(np.arange(n), len(centres)), np.tile(np.arange(len(centres)), n)
    reached = np.zeros(len(row), points.dtype)
    bound, done, level = None, 0, 1
    while done < dims:
        gap = points[row, done:level] - centres[col, done:level]
        reached = reached + (gap * gap).sum(axis=1)
        done, level = level, 2 * level
        starts = _row_starts(row)
        least = np.minimum.reduceat(reached, starts)
        ties = np.flatnonzero(reached == least[row])
        lead = ties[_row_starts(row[ties])]
        rest = points[:, done:] - centres[col[lead], done:]
        whole = least + (rest * rest).sum(axis=1)
        bound = whole if bound is None else np.minimum(bound, whole)
        if done < dims:
            live = np.flatnonzero(reached <= bound[row])
            row, col, reached = row[live], col[live], reached[live]
    return col[lead], least


def integers(components: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers if they all allow it, else as Python integers."""
    with np.errstate(over="ignore"):  # what overflows takes the exact way
        scaled = np.floor(components * SCALE)
    if len(scaled) == 0 or np.abs(scaled).max() <= _SAFE:
        return scaled.astype(np.int64)
    exact = [[int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE) for x in row] for row in components.tolist()]
    return np.array(exact, dtype=object)


def _pieces(batch: pa.RecordBatch, dims: int, rows: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        flat = part["components"].flatten().to_numpy(zero_copy_only=False)
        yield part["id"], integers(flat.reshape(part.num_rows, dims))


class _Search:
    """Centroids with their coefficients, in 64-bit integers as long as both sides allow it."""

    def __init__(self, centroids: list[list[int]]):
        self.order = sequency_order(len(centroids[0]))
        self.exact = np.array(centroids, dtype=object)
        self.plain = self.exact.astype(np.int64) if abs(self.exact).max() <= _SAFE else None

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.plain is not None and vectors.dtype != object
        centres, points = (self.plain, vectors) if both else (self.exact, vectors.astype(object))
        number, distance = nearest(transformed(points, self.order), transformed(centres, self.order))
        return number, distance // points.shape[1]


def _limbs(total: list[int]) -> list[list[int]]:
    """Sums in parts of 32 bits, the last with the sign, so that parts of many tasks add up in 64 bits."""
    out = []
    while True:
        if all(-(1 << _LIMB) <= t < 1 << _LIMB for t in total):
            return [*out, total]
        out.append([t & ((1 << _LIMB) - 1) for t in total])
        total = [t >> _LIMB for t in total]


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round."""
    k, dims = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, total = _Search(centroids), [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            for _, points in _pieces(batch, dims, max(1, _PAIRS // k)):
                number, _ = search(points)
                by = np.argsort(number, kind="stable")
                starts = _row_starts(number[by])
                for c, n, s in zip(number[by][starts], np.diff(starts, append=len(by)), np.add.reduceat(points[by], starts, axis=0)):
                    counts[c] += int(n)
                    total[c] = [a + b for a, b in zip(total[c], s.tolist())]
        rows = [(c, i, n if i == 0 else 0, limb) for c, n in enumerate(counts) if n for i, limb in enumerate(_limbs(total[c]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SUM_TYPES)], names=["c", "limb", "n", "sums"])

    found = vectors.mapInArrow(sums, "c int, limb int, n long, sums array<long>").groupBy("c", "limb")
    rows = found.agg(F.sum("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)])).collect()  # k times a few limbs
    counts, total = [0] * k, [[0] * dims for _ in range(k)]
    for c, limb, n, s in rows:
        counts[c] += n
        total[c] = [a + (b << (_LIMB * limb)) for a, b in zip(total[c], s)]
    return [[t // n for t in sums] if n else old for old, n, sums in zip(centroids, counts, total)]


_SUM_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; equal hashes by id, then by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, F.col("id").asc_nulls_last(), "components").limit(k).collect()
    return [integers(np.array([r["components"]])).tolist()[0] for r in rows]


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> list[list[int]]:
    """Integer centroids of vectors as `kept` returns them, after `rounds` rounds; a centroid without vectors stays."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """id, cluster and squared distance of every vector that `kept` returns."""
    kind = dict(vectors.dtypes)["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Search(centroids) if centroids else None
        for batch in batches:
            for ids, points in _pieces(batch, len(centroids[0]), max(1, _PAIRS // len(centroids))) if found else ():
                number, distance = found(points)
                whole = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(whole, pa.int64())], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(search, f"id {kind}, cluster int, distance long")


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Assignments with the sum of distances over their cluster and over all. The sums, one row per cluster, pass the
    driver; `assigned` is read once for them and once for the result."""
    known = F.count(F.lit(1)) == F.count("distance")
    by = assigned.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("sum"))
    sums = {r["cluster"]: None if r["sum"] is None else int(r["sum"]) for r in by.collect()}
    every = sum(sums.values()) if None not in sums.values() else None
    number = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    of_cluster = F.array(*[number(sums.get(c)) for c in range(max(sums, default=0) + 1)])
    return assigned.withColumn("cluster_inertia", F.element_at(of_cluster, F.col("cluster") + 1)).withColumn("inertia", number(every))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
