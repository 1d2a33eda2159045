"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Every text becomes a sparse vector: its distinct words hashed into `BUCKETS`, with square-root counts scaled to
unit length, and one indicator per structure statistic for the range its value falls in (length, letter case,
signs, tables, repetition of words, lines and passages, variety). The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions cost one pass over the non-zero entries.

The model is fitted on at most `SAMPLE` labelled documents, in order of a hash of their ids; every document is
scored from its whole text. Language, source, id and labels are not inputs. Defined cases: null and empty texts
have no words and zero statistics; null labels and labels of unknown documents teach nothing; without labels of both
kinds the score is the smoothed share of label 1; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import sampled
from labtide.llm.shingling import BASES, Rolling, WordHashes, binary

#: Labelled documents used to fit.
SAMPLE = 8_000
BUCKETS = 1 << 14
FACTORS = 8
RANGES = 12
EPOCHS, BATCH, RATE = 12, 128, 0.08
PENALTY = 2e-4
SEED = 7

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_SIGNS = b"#*$%&<>~^"
STATISTICS = (
    "words", "word length", "capitals", "exclamations", "signs", "bars", "digits", "stops", "variety", "stutter",
    "repeated lines", "repeated passages", "commonest word", "line length", "other bytes",
)
SIZE = BUCKETS + len(STATISTICS) * RANGES


def _share(text: bytes, among: bytes, of: int) -> float:
    return (len(text) - len(text.translate(None, among))) / of


def describe(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values, and the structure statistics."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    codes = hashes.of([w.lower() for w in words])
    if n:
        kinds, counts = np.unique(codes, return_counts=True)
        stutter = float(np.mean(codes[1:] == codes[:-1])) if n > 1 else 0.0
        passages = Rolling(codes, BASES[0]).windows(5)
        repeated = 1 - len(np.unique(passages)) / len(passages) if len(passages) else 0.0
        buckets, place = np.unique((kinds & np.uint64(BUCKETS - 1)).astype(np.int64), return_inverse=True)
        values = np.sqrt(np.bincount(place, counts))
        values /= np.linalg.norm(values)
        variety, most = len(kinds) / n**0.85, float(counts.max()) / (n + 20)
    else:
        buckets, values = np.zeros(0, np.int64), np.zeros(0)
        stutter = repeated = variety = most = 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds_of_line = Counter(lines)
    statistics = [
        np.log1p(n), size / (n + 1), _share(text, _UPPER, size), text.count(b"!") / (n + 5), _share(text, _SIGNS, n + 5),
        text.count(b"|") / (n + 5), _share(text, _DIGITS, size), _share(text, b".?;:", n + 5), variety, stutter,
        (len(lines) - len(kinds_of_line)) / (len(lines) + 3), repeated * n / (n + 20), most, np.log1p(n / (len(lines) + 1)),
        sum(map(len, kinds_of_line)) / size,
    ]
    return buckets, values, statistics


def _entries(buckets, values, statistics, edges) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's vector: words, then one indicator per statistic."""
    ranges = [np.searchsorted(edges[j], s, "left") for j, s in enumerate(statistics)]
    at = BUCKETS + np.arange(len(statistics)) * RANGES + np.array(ranges)
    return np.concatenate([buckets, at]), np.concatenate([values, np.full(len(at), 0.5)])


def _raw(x: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output before the logistic, and the factor sums, of n documents given by their entries."""
    v = model["v"][x] * values[:, None]
    starts = np.searchsorted(owner, np.arange(n))
    sums = np.add.reduceat(v, starts, axis=0)
    squares = np.add.reduceat(v * v, starts, axis=0)
    linear = np.add.reduceat(model["w"][x] * values, starts)
    return model["w0"] + linear + 0.5 * (sums * sums - squares).sum(1), sums


def fit(rows: list[tuple]) -> dict:
    """The machine from (buckets, values, statistics, label) of the sample, by adaptive gradient steps."""
    y = np.array([r[3] for r in rows], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    model = {
        "w0": float(np.log(prior / (1 - prior))), "w": np.zeros(SIZE), "v": np.zeros((SIZE, FACTORS)),
        "edges": [np.zeros(0)] * len(STATISTICS),
    }
    if not 0 < y.sum() < len(y):
        return model
    table = np.array([r[2] for r in rows])
    cuts = np.linspace(0, 1, RANGES + 1)[1:-1]
    model["edges"] = [np.unique(np.concatenate([np.quantile(c, cuts[::2]), np.quantile(c[y == 0], cuts[1::2])])) for c in table.T]
    vectors = [_entries(np.asarray(b), np.asarray(v), s, model["edges"]) for b, v, s, _ in rows]
    random = np.random.default_rng(SEED)
    model["v"] = random.normal(0, 0.05, (SIZE, FACTORS))
    gw, gv = np.full(SIZE, 1e-3), np.full((SIZE, FACTORS), 1e-3)
    for epoch in range(EPOCHS):
        for part in np.array_split(random.permutation(len(y)), -(-len(y) // BATCH)):
            x = np.concatenate([vectors[i][0] for i in part])
            values = np.concatenate([vectors[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(vectors[i][0]) for i in part])
            raw, sums = _raw(x, values, owner, len(part), model)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part) * 16
            model["w0"] -= RATE * 0.1 * float(error.mean())
            touched, place = np.unique(x, return_inverse=True)
            pull = error[owner] * values
            step = np.bincount(place, pull) + PENALTY * model["w"][touched]
            gw[touched] += step * step
            model["w"][touched] -= RATE * step / np.sqrt(gw[touched])
            slope = pull[:, None] * (sums[owner] - model["v"][x] * values[:, None])
            steps = np.stack([np.bincount(place, slope[:, f]) for f in range(FACTORS)], 1) + PENALTY * model["v"][touched]
            gv[touched] += steps * steps
            model["v"][touched] -= RATE * steps / np.sqrt(gv[touched])
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, limit: int = SAMPLE) -> dict:
    """The fitted machine. `train` is a condition on the doc_id column of `labels`."""
    picked = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    picked = sampled(picked.groupBy("doc_id").agg(F.max("quality").alias("quality")), limit, "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [describe(t, hashes) for t in binary(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([b.astype(np.int32).tobytes() for b, _, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v, _ in found], pa.binary()),
                    pa.array([[float(x) for x in s] for _, _, s in found], pa.list_(pa.float64())), batch["quality"],
                ],
                names=["doc_id", "buckets", "weights", "statistics", "quality"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, buckets binary, weights binary, statistics array<double>, quality int"
    rows = sample.mapInArrow(described, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))  # arrival order differs between runs
    return fit([
        (np.frombuffer(bytes(r["buckets"]), np.int32), np.frombuffer(bytes(r["weights"]), np.float32).astype(float), r["statistics"], int(r["quality"] != 0))
        for r in rows
    ])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher for better) of every document, from its whole text."""
    small = model | {"w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}
    sent = docs.sparkSession.sparkContext.broadcast(small)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fitted = WordHashes(), sent.value
        for batch in batches:
            out = []
            for text in binary(batch["text"]):
                x, values = _entries(*describe(text, hashes), fitted["edges"])
                raw, _ = _raw(x, values, np.zeros(len(x), np.int64), 1, fitted)
                out.append(float(1 / (1 + np.exp(-np.clip(raw[0], -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
