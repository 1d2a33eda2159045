"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class, given the tokens before it, times that of the token inside
its class. A class is a cluster with a frequency range; first the cluster is predicted, then the range inside it, each
by a maximum-entropy model whose features are hashed into `BUCKETS` rows of weights: the last word, the word before
it (a skip), both together, and the classes of the last three. Inside a class a token has its share of the class's
training count.

1. Clusters. A mixture of unigram distributions over all training documents groups texts that use the same words
   (languages, styles). Every turn of its expectation maximisation is one pass: tasks add up the words of their
   documents for all starts at once, and the sums are shuffled by word. A document counts for one cluster, drawn by
   its memberships, so that a word is one addition.
2. Counts. All training documents are counted by word and cluster of the document, combined per task and
   shuffled by word. The vocabulary stays a table; only the most frequent words, at most `DICTIONARY`, go to the
   tasks. Their class is their cluster with their frequency range. A rarer word's class is the cluster
   that its ending has most often, so that unseen words have one too.
3. Weights. The first weights are counts of each feature with each cluster and range over all training documents.
   From these, each task takes gradient steps over its documents, and the tasks' weights are averaged by their tokens.
4. Scores. Texts are scored in batches of numpy rows. The counts of rarer words are joined: each task lists their
   hashes per document and the counts come back as one sum per document.

Tokens: A-Z in lower case, words between white space, then one end of text. Classes, each with one unseen word, add
up to one. Defined cases: a null or empty text is only the end; without training documents all counts are zero
and the scores finite; rows are scored one by one, repeated rows alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import least_count, settled
from labtide.llm.shingling import binary, mixed, spaced_lower

CLUSTERS = 8
#: Random starts of the cluster mixture, of which the best counts.
STARTS = 4
#: Turns over all training documents; in the first ones memberships are smoothed, less each time.
TURNS, SMOOTHED = 12, 10
#: Documents that a task adds up in one turn; it sends back as many sums whatever it has read.
TASK_BAGS = 25_000
#: Most words sent to the tasks with their counts, and frequency ranges of their classes.
DICTIONARY = 200_000
RANGES = 8
ENDING, ENDINGS = 3, 4096
BUCKETS = 1 << 14
#: Rows of weights that travel together, and groups that tasks are averaged in before all are.
BLOCK = 64
PARTS = 1024
SUM_BLOCK = 1 << 16
CLUSTER_BUCKETS = 1 << 15
#: Tokens per gradient step, and the learning rate.
STEP, RATE = 2048, 0.15
#: Tokens that a learning task reads at least.
TASK_TOKENS = 2_000_000
_RARE_CLASSES = CLUSTERS * RANGES
_END_CLASS = _RARE_CLASSES + CLUSTERS
CLASSES = _END_CLASS + 1
#: Choices per table of weights (a cluster or the end; a range or the rare words of a cluster), and tables per bucket.
SIDE = max(CLUSTERS, RANGES) + 1
TABLES = CLUSTERS + 1
#: How much a feature's counts need to outweigh the mean, and the part of their logarithm that starts its weight.
DOUBT, PART = 20.0, 0.4
_NO_WORD = np.uint64(0x1B873593CC9E2D51)


# ---- clusters

def _bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return np.unique((codes & np.uint32(CLUSTER_BUCKETS - 1)).astype(np.uint16), return_counts=True)


class Space(dict):
    """Arrays that are used again at every step; fresh memory costs more than the arithmetic."""

    def of(self, name: str, *shape: int, dtype: type = np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or len(self[name]) < size:
            self[name] = np.empty(size, dtype)
        return self[name][:size].reshape(shape)


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sums(bags: Iterable[tuple[np.ndarray, np.ndarray]], log: np.ndarray, prior: np.ndarray, heat: float) -> Sums:
    """Words (buckets by starts and clusters), memberships and log likelihoods under all starts at once."""
    words, flat_prior = np.zeros(log.size, np.float32), prior.ravel()
    members, total = np.zeros(prior.shape), np.zeros(len(prior))
    space, bags = Space(), ((x, np.log1p(n, dtype=np.float32)) for x, n in bags if len(x))
    columns = np.arange(len(prior)) * CLUSTERS
    while held := list(islice(bags, 256)):
        fit, codes = np.empty((len(held), log.shape[1])), np.empty(len(held), np.uint64)
        for i, (x, n) in enumerate(held):
            fit[i] = n @ log.take(x, axis=0, out=space.of("log", len(x), log.shape[1]), mode="clip")
            codes[i] = zlib.crc32(x)
        fit = ((fit + flat_prior) * heat).reshape(len(held), *prior.shape)
        top = fit.max(2, keepdims=True)
        share = np.exp(fit - top)
        sums = share.sum(2, keepdims=True)
        share /= sums
        total += (top + np.log(sums)).sum((0, 2))
        members += share.sum(0)
        # the same draw for the same words, whatever task reads them
        draw = (mixed(codes[:, None] + (columns.astype(np.uint64) << np.uint64(32))) >> np.uint64(11)) / (1 << 53)
        drawn = columns + np.minimum((share.cumsum(2) < draw[:, :, None]).sum(2), CLUSTERS - 1)
        for (x, n), mine in zip(held, drawn):
            at = x.astype(np.int64) * log.shape[1]
            words[mine[:, None] + at] += n
    return words.reshape(log.shape), members, total


def _mixture(bags, turn: Callable[..., Sums] = _sums) -> np.ndarray:
    """Log word distributions of the clusters, a column each, by expectation maximisation from several starts."""
    starts = [np.random.default_rng(seed).normal(size=(CLUSTER_BUCKETS, CLUSTERS)) for seed in range(STARTS)]
    log, prior = np.concatenate(starts, 1).astype(np.float32), np.zeros((STARTS, CLUSTERS))
    for i in range(TURNS):
        words, members, total = turn(bags, log, prior, min(1.0, (i + 1) / SMOOTHED))
        if members[0].sum() < CLUSTERS - 0.5:
            return np.zeros((CLUSTER_BUCKETS, CLUSTERS), np.float32)
        words = words.reshape(CLUSTER_BUCKETS, STARTS, CLUSTERS).astype(float)
        every = words[:, :1].sum(2, keepdims=True) + 0.1
        words += 0.02 * every / every.sum() * (words.sum(0) + 1)
        log = np.log(words / words.sum(0)).astype(np.float32).reshape(log.shape)
        prior = np.log(members / members.sum(1, keepdims=True) + 1e-6)
    return np.ascontiguousarray(log.reshape(words.shape)[:, int(total.argmax())])


def _summed(tasks: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum of one array of `size` numbers per task, added up in blocks that are shuffled."""
    blocks = math.ceil(size / SUM_BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sums(batches)
        if found is not None:
            parts = [found[b * SUM_BLOCK : (b + 1) * SUM_BLOCK].astype(np.float32).tobytes() for b in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(parts, pa.binary())], names=["block", "sums"])

    def add(group: pa.Table) -> pa.Table:
        # in order of content, so that the sum does not depend on the order of arrival
        total = sum(np.frombuffer(w, np.float32).astype(float) for w in sorted(group["sums"].to_pylist()))
        return pa.table({"block": group["block"].slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros(size)
    for r in tasks.mapInArrow(cut, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect():
        part = np.frombuffer(bytes(r["sums"]), np.float32)
        out[r["block"] * SUM_BLOCK :][: len(part)] = part
    return out


def _sums_of_all(bags: DataFrame, log: np.ndarray, prior: np.ndarray, heat: float) -> Sums:
    sent = bags.sparkSession.sparkContext.broadcast((log, prior))

    def one(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        rows = ((x, n) for batch in batches for x, n in zip(batch["x"].to_pylist(), batch["n"].to_pylist()))
        held = ((np.frombuffer(x, np.uint16), np.frombuffer(n, np.uint8 if 2 * len(n) == len(x) else np.int32)) for x, n in rows)
        return np.concatenate([part.ravel() for part in _sums(held, *sent.value, heat)])

    found = _summed(bags, one, log.size + prior.size + len(prior))
    sent.unpersist()
    words, members, total = np.split(found, [log.size, log.size + prior.size])
    return words.reshape(log.shape), members.reshape(prior.shape), total


def clusters(docs: DataFrame, train: Column) -> np.ndarray:
    """Log word distributions of the clusters, from all training documents."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bag(spaced_lower(t)) for t in binary(batch["text"])]
            # counts take a byte each, or four in a text that needs it
            counts = [n.astype(np.uint8 if len(n) and n.max() < 256 else np.int32).tobytes() for _, n in found]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array(counts, pa.binary())], names=["x", "n"])

    held = settled(docs.where(train).select("text").mapInArrow(bags, "x binary, n binary"))
    return _mixture(held.coalesce(max(1, math.ceil(held.count() / TASK_BAGS))), _sums_of_all)


# ---- counts

def word_counts(docs: DataFrame, train: Column, centres: np.ndarray) -> DataFrame:
    """word (binary), n and count per cluster k0, k1, ... over all training documents."""
    sent = docs.sparkSession.sparkContext.broadcast(centres)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = sent.value
        for batch in batches:
            held = [Counter() for _ in range(CLUSTERS)]
            for text in binary(batch["text"]):
                words = spaced_lower(text)
                if words:
                    x, n = _bag(words)
                    held[int((np.log1p(n, dtype=np.float32) @ log[x]).argmax())].update(words)
            for k, counts in enumerate(held):
                if counts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counts), pa.binary()), pa.array(np.full(len(counts), k, np.int32)), pa.array(list(counts.values()), pa.int64())],
                        names=["word", "k", "n"],
                    )

    counted = docs.where(train).select("text").mapInArrow(count, "word binary, k int, n long")
    return counted.groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(CLUSTERS)]
    )


def _dominant(prefix: str = "k") -> Column:
    """The first cluster with the largest count."""
    largest = F.greatest(*[F.col(f"{prefix}{k}") for k in range(CLUSTERS)])
    return F.coalesce(*[F.when(F.col(f"{prefix}{k}") == largest, F.lit(k)) for k in range(CLUSTERS)])


def _ending() -> Column:
    start = F.greatest(F.length("word") - ENDING + 1, F.lit(1))
    return (F.crc32(F.substring(F.col("word"), start, F.lit(ENDING))) % ENDINGS).cast("int")


def vocabulary(docs: DataFrame, train: Column) -> tuple[dict, DataFrame]:
    """What the tasks need to know, and the table of rarer words (hash h, count n).

    The word column is compared as bytes; the hash of a rarer word is Spark's xxhash64 of its bytes.
    """
    ends = docs.where(train).count()
    centres = clusters(docs, train)
    words = settled(
        word_counts(docs, train, centres).select("word", "n", _dominant().alias("cluster"), _ending().alias("ending"), *[f"k{k}" for k in range(CLUSTERS)])
    )
    total = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    kinds, tokens = total[0] + (ends > 0), (total[1] or 0) + ends
    by_ending = words.groupBy("ending").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(CLUSTERS)]).select("ending", _dominant().alias("cluster"))
    endings = np.zeros(ENDINGS, np.int64)
    for r in by_ending.collect():
        endings[r["ending"]] = r["cluster"]
    least = least_count(words, DICTIONARY)
    frequent = words.where(F.col("n") >= least).select("word", "n", "cluster").collect()
    frequent.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    rare = words.where(F.col("n") < least)
    place = F.element_at(F.array(*[F.lit(int(c)) for c in endings]), F.col("ending") + 1)
    rare_sums = {r["c"]: (r["n"], r["w"]) for r in rare.groupBy(place.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect()}
    n = np.array([r["n"] for r in frequent], np.int64)
    top = math.log2(max(2, n.max())) if len(n) else 1.0
    floor = math.log2(max(1, n.min())) if len(n) else 0.0
    band = np.minimum(((np.log2(np.maximum(n, 1)) - floor) / max(1e-9, top - floor + 1e-9) * RANGES).astype(np.int64), RANGES - 1)
    of = np.array([r["cluster"] for r in frequent], np.int64) * RANGES + band
    sums = np.bincount(of, n, CLASSES) if len(n) else np.zeros(CLASSES)
    known = {
        "ids": {bytes(r["word"]): i for i, r in enumerate(frequent)}, "n": n, "class": of, "endings": endings, "ends": ends,
        "kinds": kinds, "tokens": tokens, "inside": np.log10(n / sums[of]) if len(n) else np.zeros(0),
        "rare_total": np.array([rare_sums.get(c, (0, 0))[0] + 0.5 * (rare_sums.get(c, (0, 0))[1] + 1) for c in range(CLUSTERS)]),
    }
    return known, rare.select(F.xxhash64("word").alias("h"), "n")


# ---- tokens and features

class Ids(dict):
    """Dictionary position of a word; for others the dictionary's length plus the cluster of their ending."""

    def __init__(self, known: dict):
        super().__init__(known["ids"])
        self.size, self.extra, self.endings = len(known["ids"]), 0, known["endings"]

    def __missing__(self, word: bytes) -> int:
        return self.size + int(self.endings[zlib.crc32(word[-ENDING:]) % ENDINGS])

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _classes(known: dict) -> np.ndarray:
    """Class of every token number: dictionary words, the rare clusters, the end."""
    return np.concatenate([known["class"], _RARE_CLASSES + np.arange(CLUSTERS), [_END_CLASS]]).astype(np.int64)


def _features(tokens: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Buckets of the tokens' features, a column per token. `first` marks the first token of each text; nothing before it is seen."""
    place = np.arange(len(tokens)) - np.maximum.accumulate(np.where(first, np.arange(len(tokens)), 0))
    code, kind = mixed(tokens.astype(np.uint64) + np.uint64(1)), classes[tokens].astype(np.uint64)

    def back(values: np.ndarray, steps: int) -> np.ndarray:
        out = np.full(len(values), _NO_WORD)
        out[steps:] = values[: len(values) - steps] if steps < len(values) else out[steps:]
        return np.where(place >= steps, out, _NO_WORD)

    one, two = back(code, 1), back(code, 2)
    classes_before = back(kind, 1) * np.uint64(1_000_003) + back(kind, 2) * np.uint64(999_983) + back(kind, 3)
    hashed = [one, two + np.uint64(0x51ED27), one * np.uint64(3) + mixed(two), mixed(classes_before) ^ np.uint64(0xABCDEF)]
    out = np.zeros((len(hashed) + 1, len(tokens)), np.int64)
    for i, h in enumerate(hashed):
        out[i + 1] = 1 + (mixed(h) % np.uint64(BUCKETS - 1)).astype(np.int64)
    return out


def _choices(features: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights and what is chosen: the cluster (or the end) of every token, then the range of those in a cluster."""
    rare = kinds >= _RARE_CLASSES
    cluster = np.where(rare, kinds - _RARE_CLASSES, kinds // RANGES)
    inner = np.flatnonzero(cluster < CLUSTERS)
    rows = features * TABLES
    chosen = np.where(rare, RANGES, kinds % RANGES)
    return np.concatenate([rows, rows[:, inner] + 1 + cluster[inner]], 1), np.concatenate([cluster, chosen[inner]])


def _raw(rows: np.ndarray, weights: np.ndarray, space: Space) -> np.ndarray:
    """Sums of the weights of each choice's features, with a largest of zero; a column per choice."""
    table, n = weights.reshape(-1, SIDE), rows.shape[1]
    raw = table.take(rows[0], axis=0, out=space.of("raw", n, SIDE), mode="clip")
    for row in rows[1:]:
        raw += table.take(row, axis=0, out=space.of("more", n, SIDE), mode="clip")
    turned = space.of("turned", SIDE, n)
    turned[:] = raw.T
    turned -= turned.max(0)
    return turned


def _log_choices(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    raw = _raw(rows, weights, Space())
    return raw - np.log(np.exp(raw).sum(0))


def _log_classes(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log probabilities of all classes, a row per token."""
    out = np.empty((features.shape[1], CLASSES), np.float32)
    top = _log_choices(features * TABLES, weights)
    for k in range(CLUSTERS):
        inner = top[k] + _log_choices(features * TABLES + 1 + k, weights)
        out[:, k * RANGES : (k + 1) * RANGES] = inner[:RANGES].T
        out[:, _RARE_CLASSES + k] = inner[RANGES]
    out[:, _END_CLASS] = top[CLUSTERS]
    return out


def _log_class(features: np.ndarray, kinds: np.ndarray, weights: np.ndarray, space: Space) -> np.ndarray:
    """Log probability of each token's own class."""
    rows, chosen = _choices(features, kinds)
    raw = _raw(rows, weights, space)
    own = raw[chosen, np.arange(len(chosen))]
    own -= np.log(np.exp(raw, out=raw).sum(0))
    out = own[: len(kinds)]
    out[kinds != _END_CLASS] += own[len(kinds) :]
    return out


def _token_chunks(batch: pa.RecordBatch, ids: Ids, most: int = 8_000) -> Iterator[tuple]:
    """Texts' token numbers joined, marks of first tokens, and the rows and their word lists."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(binary(batch["text"])):
        words = spaced_lower(text)
        parts.append(np.append(ids.of(words), ids.size + CLUSTERS))
        rows.append((i, words))
        held += len(words) + 1
        if held >= most:
            yield _joined(parts), rows, parts
            rows, parts, held = [], [], 0
    if parts:
        yield _joined(parts), rows, parts


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate(parts)
    first = np.zeros(len(tokens), bool)
    first[np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)] = True
    return tokens, first


# ---- weights

def start_weights(known: dict) -> np.ndarray:
    """No choice for unused places; else zero, but for the first row: the logarithms of the classes' training counts."""
    counts = np.bincount(known["class"], known["n"], CLASSES) if len(known["n"]) else np.zeros(CLASSES)
    counts[_RARE_CLASSES:_END_CLASS] = known["rare_total"]
    counts[_END_CLASS] = known["ends"]
    counts += 0.5
    weights = np.zeros((BUCKETS, TABLES, SIDE), np.float32)
    weights[0] = -np.inf
    inner = np.concatenate([counts[:_RARE_CLASSES].reshape(CLUSTERS, RANGES), counts[_RARE_CLASSES:_END_CLASS, None]], 1)
    weights[0, 0, :TABLES] = np.log(np.append(inner.sum(1), counts[_END_CLASS]) / counts.sum())
    weights[0, 1:, : RANGES + 1] = np.log(inner / inner.sum(1, keepdims=True))
    return weights.reshape(BUCKETS, -1)


def counted_weights(docs: DataFrame, known: dict, weights: np.ndarray) -> np.ndarray:
    """The weights with those of each feature set from its counts with every choice, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        ids, classes = Ids(sent.value), _classes(sent.value)
        found = np.zeros(weights.size)
        for batch in batches:
            for (tokens, first), _, _ in _token_chunks(batch, ids):
                rows, chosen = _choices(_features(tokens, classes, first)[1:], classes[tokens])
                np.add.at(found, (rows * SIDE + chosen).ravel(), 1.0)
        return found

    shape = (BUCKETS, TABLES, SIDE)
    counts = _summed(_learners(docs, known), count, weights.size).reshape(shape)
    mean = np.exp(weights.reshape(shape)[0].astype(float))
    ratio = (counts + DOUBT * mean) / (counts.sum(2, keepdims=True) + DOUBT) / np.where(mean > 0, mean, 1)
    out = (PART * np.log(np.where(mean > 0, ratio, 1))).astype(np.float32)
    out[0] = weights.reshape(shape)[0]
    return out.reshape(weights.shape)


def _learners(docs: DataFrame, known: dict) -> DataFrame:
    """The texts in tasks: one sends back as many numbers whatever it has read, so each reads a fair share of the tokens."""
    return docs.select("text").coalesce(max(1, math.ceil(known["tokens"] / TASK_TOKENS)))


def _descend(tokens: np.ndarray, first: np.ndarray, classes: np.ndarray, weights: np.ndarray, grown: np.ndarray, space: Space) -> None:
    """Gradient steps over the tokens in order, in place; `grown` holds each row's squared gradients."""
    features, kinds, table = _features(tokens, classes, first), classes[tokens], weights.reshape(-1, SIDE)
    for at in range(0, len(tokens), STEP):
        rows, chosen = _choices(features[:, at : at + STEP], kinds[at : at + STEP])
        n = len(chosen)
        error = _raw(rows, weights, space)
        np.exp(error, out=error)
        error /= error.sum(0)
        error[chosen, np.arange(n)] -= 1
        by_choice = space.of("raw", n, SIDE)
        by_choice[:] = error.T
        # row and choice in one number, which sorts faster than a stable order is found
        keyed = space.of("keyed", *rows.shape, dtype=np.int64)
        np.left_shift(rows, 16, out=keyed)
        keyed |= np.arange(n)
        keyed = keyed.ravel()
        keyed.sort()
        place = np.bitwise_and(keyed, 0xFFFF, out=space.of("place", len(keyed), dtype=np.int64))
        keyed >>= 16
        starts = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
        hit = keyed[starts]
        slope = by_choice.take(place, axis=0, out=space.of("slope", len(place), SIDE), mode="clip")
        slope = np.add.reduceat(slope, starts, axis=0, out=space.of("sum", len(starts), SIDE))
        rate = grown[hit] + np.einsum("ij,ij->i", slope, slope) / SIDE
        grown[hit] = rate
        slope *= (RATE / np.sqrt(rate))[:, None]
        now = table.take(hit, axis=0, out=space.of("now", len(hit), SIDE), mode="clip")
        now -= slope
        table[hit] = now


def learned(docs: DataFrame, known: dict, weights: np.ndarray) -> np.ndarray:
    """Weights after gradient steps of every task over its documents, averaged by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast((known, weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, began = sent.value
        ids, classes, space = Ids(known), _classes(known), Space()
        mine, grown, seen = began.copy(), np.ones(BUCKETS * TABLES, np.float32), 0
        for batch in batches:
            for (tokens, first), _, _ in _token_chunks(batch, ids):
                _descend(tokens, first, classes, mine, grown, space)
                seen += len(tokens)
        if seen:
            blocks = BUCKETS // BLOCK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, seen % PARTS, np.int32)),
                    pa.array([mine[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(blocks)], pa.binary()),
                    pa.array(np.full(blocks, seen, np.int64)),
                ],
                names=["block", "part", "weights", "tokens"],
            )

    def average(group: pa.Table) -> pa.Table:
        total, tokens = np.zeros(BLOCK * TABLES * SIDE), 0
        # in order of content, so that the sum does not depend on the order of arrival
        for w, n in sorted(zip(group["weights"].to_pylist(), group["tokens"].to_pylist())):
            total += np.frombuffer(w, np.float32).astype(float) * n
            tokens += n
        return pa.table({
            "block": group["block"].slice(0, 1), "part": pa.array([0], pa.int32()),
            "weights": pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([tokens], pa.int64()),
        })

    schema = "block int, part int, weights binary, tokens long"
    sent_back = _learners(docs, known).mapInArrow(learn, schema).groupBy("block", "part").applyInArrow(average, schema)
    rows = sent_back.groupBy("block").applyInArrow(average, schema).collect()
    out = weights.copy()
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["weights"]), np.float32).reshape(BLOCK, -1)
    return out


def fit(docs: DataFrame, train: Column) -> tuple[dict, DataFrame, np.ndarray]:
    """Known words, the table of rarer ones, and the weights, from the documents that `train` selects."""
    known, rare = vocabulary(docs, train)
    weights = start_weights(known)
    if known["ends"]:
        weights = counted_weights(docs.where(train), known, weights)
        weights = learned(docs.where(train), known, weights)
    return known, rare, weights


# ---- scores

def score(docs: DataFrame, known: dict, rare: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((known, weights))
    log_all = math.log10(known["tokens"] + 0.5 * (known["kinds"] + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        ids, classes, space = Ids(known), _classes(known), Space()
        size = ids.size
        base = np.concatenate([np.log10(known["n"] + 0.5), np.zeros(CLUSTERS), [math.log10(known["ends"] + 0.5)]])
        inside = np.concatenate([known["inside"], -np.log10(known["rare_total"]), [0.0]])
        for batch in batches:
            count, seen, plain, model, rest = [], [], [], [], []
            for (tokens, first), rows, parts in _token_chunks(batch, ids):
                features, kinds = _features(tokens, classes, first), classes[tokens]
                log = np.empty(len(tokens))
                for at in range(0, len(tokens), STEP):
                    part = slice(at, at + STEP)
                    log[part] = _log_class(features[:, part], kinds[part], weights, space)
                starts = np.flatnonzero(first)
                plain += np.add.reduceat(base[tokens], starts).tolist()
                model += (np.add.reduceat(log / math.log(10) + inside[tokens], starts)).tolist()
                for (_, words), numbers in zip(rows, parts):
                    is_rare = numbers[:-1] >= size
                    count.append(len(numbers))
                    seen.append(int((~is_rare).sum()) + (known["ends"] > 0))
                    rest.append(np.array([xxhash.xxh64_intdigest(words[i], 42) for i in np.flatnonzero(is_rare)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(count, pa.int64()), pa.array(seen, pa.int64()), pa.array(plain, pa.float64()),
                    pa.array(model, pa.float64()), pa.array(rest, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_tokens", "seen", "plain", "model", "rest"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, seen long, plain double, model double, rest array<long>"
    # row numbers hold because they are given to rows that are already written
    rows = settled(docs.select("doc_id", "text").mapInArrow(scored, schema)).withColumn("row", F.monotonically_increasing_id())
    asked = rows.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("times"))
    counts = rare.groupBy("h").agg(F.max("n").alias("n"))
    answered = asked.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("part"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
    )
    part = F.coalesce("part", F.lit(0.0))
    return rows.join(answered, "row", "left").select(
        "doc_id", "n_tokens", (F.col("seen") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(known["tokens"]).cast("long").alias("train_tokens"),
        (F.col("plain") + part - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + part).alias("score"),
    )
