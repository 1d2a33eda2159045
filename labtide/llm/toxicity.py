"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length.

Folding maps every character to a lower-case letter where it stands for one: look-alike letters of other
scripts become Latin, and digits or signs written for letters inside a word become these. What is left is words
between single spaces. A word with accents is also looked up without them, as a whole word.

The lexicon is learned from labelled documents: whole words and word beginnings that are much more frequent,
per word of text, in toxic documents. A pattern's weight is the logarithm of that ratio. At a word, the longest
pattern counts. Exception phrases, a pattern with its neighbour that only clean documents have, count nothing.
The sum of weights over the number of words, with the sum itself, gives the score by a logistic curve.

At most `SAMPLE` labelled documents, in order of a hash of their ids, are used to learn; every document is
scored, whole. Defined cases: null and empty texts have no words and score like any text without a match;
labels that are null, and labels of unknown documents, teach nothing; with no toxic or no clean label the score is
the smoothed share of toxic labels; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import sampled, settled

#: Labelled documents used to learn.
SAMPLE = 12_000
STEMS = range(4, 9)
#: A pattern is in at least this many toxic documents of the sample, or this part of them.
LEAST_TOXIC, LEAST_SHARE = 3, 0.004
#: Least logarithm of the ratio of rates, and most patterns kept.
LEAST_WEIGHT = 2.0
MOST_PATTERNS = 5_000
#: An exception phrase is in at least this many clean documents and in no toxic one.
EXCEPTION_CLEAN = 5
#: Ordinary words added to each text's length.
EXTRA_WORDS = 30

# Letters of other scripts that look like Latin letters, and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ь": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_SIGN = "[0134578@$]"
_FOR_LETTER = re.compile(rf"{_SIGN}(?={_SIGN}{{0,4}}[a-z])|(?<=[a-z]){_SIGN}(?![0-9a-z@$])")
_NO_LETTER = {c: " " for c in map(ord, "0123456789@$")}


class Folded(dict):
    """Code point to what it is folded to, worked out once per character; without accents if asked."""

    def __init__(self, accents: bool = True):
        super().__init__()
        self.form = "NFKC" if accents else "NFKD"

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize(self.form, chr(code).lower()):
            if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
                continue
            c = LOOK_ALIKES.get(c, c)
            out += c if c.isalpha() or c in SIGNS or c.isdigit() and c.isascii() else " "
        self[code] = out
        return out


def fold(text: str | None, table: Folded) -> str:
    """Words of plain letters between single spaces, with a space at both ends; a space for no words."""
    folded = unicodedata.normalize("NFC", text or "").translate(table)
    if re.search("[0-9@$]", folded):
        folded = _FOR_LETTER.sub(lambda m: SIGNS[m[0]], folded).translate(_NO_LETTER)
    words = folded.split()
    return f" {' '.join(words)} " if words else " "


def _patterns(words: list[str]) -> dict[str, int]:
    """Occurrences of each whole word and word beginning."""
    out: dict[str, int] = defaultdict(int)
    for w in words:
        out[f" {w} "] += 1
        for n in STEMS:
            if len(w) > n:
                out[f" {w[:n]}"] += 1
    return out


class Matcher:
    """Patterns and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.whole = {p: w for p, w in weights.items() if p[-1] == " "}
        self.bare = Folded(accents=False)

    def find(self, folded: str) -> dict[int, float]:
        """Start of each matched word and the weight of its longest pattern, without the excepted ones."""
        best: dict[int, tuple[int, float]] = {}
        excepted = []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    excepted.append((start, end))
                elif size > best.get(start, (0, 0.0))[0]:
                    best[start] = (size, weight)
        if self.whole and not folded.isascii():
            start = 0
            for word in folded.split():
                if not word.isascii() and start not in best:
                    bare = f" {word.translate(self.bare)} "
                    if bare in self.whole:
                        best[start] = (len(bare), self.whole[bare])
                start += len(word) + 1
        for a, b in excepted:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return {start: weight for start, (_, weight) in best.items()}


def _features(folded: str, found: dict[int, float]) -> tuple[float, float, float]:
    total, n = sum(found.values()), folded.count(" ") - 1
    return np.log(0.05 + 100 * total / (max(n, 0) + EXTRA_WORDS)), np.log1p(total), float(min(len(found), 3))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column, limit: int) -> DataFrame:
    """Text and label of at most `limit` training documents."""
    picked = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    picked = sampled(picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), limit, "doc_id")
    return settled(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))


def learn(docs: DataFrame, labels: DataFrame, train: Column, limit: int = SAMPLE) -> dict:
    """Weights, exceptions and the curve. `train` is a condition on the doc_id column of `labels`."""
    sample = _labelled(docs, labels, train, limit)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = Folded(), defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for pattern, n in _patterns(fold(text, table).split()).items():
                    row = counts[pattern]
                    row[0 if toxic else 2] += 1
                    row[1 if toxic else 3] += n
        columns = np.array(list(counts.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *[pa.array(columns[:, i]) for i in range(4)]], names=["pattern", "td", "tn", "cd", "cn"]
        )

    schema = "pattern string, td long, tn long, cd long, cn long"
    sums = settled(sample.mapInArrow(rates, schema).groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("td", "tn", "cd", "cn")]))
    whole = sums.where("pattern LIKE '% '").agg(F.sum("tn"), F.sum("cn")).first()
    share = sample.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0))).first()
    n, toxic = share[0], share[1] or 0
    prior = (toxic + 1) / (n + 2)
    flat = {"weights": {}, "exceptions": [], "curve": [float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0]}
    if not toxic or toxic == n:
        return flat
    ratio = F.log((F.col("tn") + 0.5) / (whole[0] + 1)) - F.log((F.col("cn") + 0.5) / (whole[1] + 1))
    strong = sums.withColumn("weight", ratio).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("td") >= max(LEAST_TOXIC, LEAST_SHARE * toxic)))
    rows = strong.orderBy(F.desc(F.col("weight") * F.col("td")), "pattern").limit(MOST_PATTERNS).collect()
    flat["weights"] = {r["pattern"]: r["weight"] for r in rows}
    flat["exceptions"] = _exceptions(sample, flat["weights"])
    flat["curve"] = _curve(sample, flat)
    return flat


def _exceptions(sample: DataFrame, weights: dict[str, float]) -> list[str]:
    """Phrases of a matched word and a neighbour that several clean and no toxic documents have."""
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, matcher = Folded(), Matcher(sent.value, [])
        for batch in batches:
            found, marks = [], []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                folded = fold(text, table)
                near = set()
                for start in matcher.find(folded):
                    end = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", end + 1)
                    near |= {folded[before : end + 1]} if before >= 0 else set()
                    near |= {folded[start : after + 1]} if after > 0 else set()
                found += near
                marks += [toxic] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["phrase", "toxic"])

    counted = sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("c")
    )
    rows = counted.where((F.col("t") == 0) & (F.col("c") >= EXCEPTION_CLEAN)).orderBy(F.desc("c"), "phrase").limit(MOST_PATTERNS)
    return [r["phrase"] for r in rows.collect()]


def _curve(sample: DataFrame, model: dict) -> list[float]:
    """Logistic regression of the label on three features, by Newton steps with a small penalty."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, matcher = Folded(), Matcher(sent.value["weights"], sent.value["exceptions"])
        for batch in batches:
            folded = [fold(text, table) for text in batch["text"].to_pylist()]
            x = np.array([_features(t, matcher.find(t)) for t in folded]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(3)], batch["toxic"]], names=["x0", "x1", "x2", "toxic"])

    rows = np.array(sample.mapInArrow(features, "x0 double, x1 double, x2 double, toxic int").collect(), float)
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :3]]), (rows[:, 3] != 0).astype(float)
    w, penalty = np.zeros(4), np.diag([1e-6, 0.3, 0.3, 0.3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4), x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
    return [float(v) for v in w]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), matches and n_words of every document, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, matcher = Folded(), Matcher(sent.value["weights"], sent.value["exceptions"])
        curve = np.array(sent.value["curve"])
        for batch in batches:
            out, hits, words = [], [], []
            for text in batch["text"].to_pylist():
                folded = fold(text, table)
                found = matcher.find(folded)
                out.append(1 / (1 + np.exp(-np.clip(curve @ np.array((1.0, *_features(folded, found))), -30, 30))))
                hits.append(len(found))
                words.append(max(0, folded.count(" ") - 1))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out, pa.float64()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())],
                names=["doc_id", "score", "matches", "n_words"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, matches long, n_words long")
