"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are of two kinds. A run is at least `LEAST` letters, digits and `+ / _ -`, of any letter case, with `=` only as
padding at its end. A value is whatever is assigned to a name that says it is a secret, or stands as the password in an
address, whatever its length and signs: inside quotes up to the closing one of the same line, else up to white space or
a quote, without closing punctuation. A run inside a longer value is a candidate of its own. Passwords that
follow their name without a sign, shorter than `LEAST`, are no candidates.

Each candidate gets features of four kinds: its length and make-up; how likely its character transitions are in ordinary
text; how much of it dictionary words cover, and the path, address or assignment it stands in; and its neighbouring words,
hashed. A random forest (Spark ML) trained from labelled findings tells secrets from identifiers, numbers, paths and words.

Transitions and the dictionary are counted over all documents, combined per task. The forest is trained on at most
`TRAIN` labelled findings in order of a hash; every candidate of every document is scored.

Labelled findings have doc_id, start (characters from the beginning of the text), is_secret, and length where one start
has several candidates. `unmatched` lists those that no candidate stands for. Where nobody has labelled any, `planted` writes secrets and
look-alikes of known kinds into pieces of at most `PLANTED` documents; the label is what was written.

Defined cases: null and empty texts have no candidates; a null doc_id keeps its findings, under null; unknown labels
are ignored; without labels of both kinds every candidate scores the smoothed share of secrets; repeated rows give
repeated findings; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtide.llm.common import least_count, sampled, settled

LEAST = 12
#: Labelled findings used to train, and words of the dictionary at most.
TRAIN = 20_000
DICTIONARY = 30_000
TREES, DEPTH = 24, 8
NEIGHBOURS = 32
#: Characters on each side that neighbouring words are looked for in.
AROUND = 60

#: Documents that labelled findings are planted in at most, findings in each, and characters kept around them.
PLANTED, EACH, PIECE = 3_000, 6, 600

_RUN = re.compile(rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/=_\-]))?")
_SIGN = re.compile(r"[:=]{1,3}>?[ \t]{0,8}")
_QUOTED = re.compile(r"\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`")
_BARE = re.compile(r"[\"'`]?([^\s\"'`]+)")
_USER = re.compile(r"://[^\s:/@]+:([^\s/@]+)@")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[a-z]{3,16}")
_ASSIGNED = re.compile(r"[\w\]][\"'`]?[ \t]{0,8}[:=]{1,3}>?[ \t]{0,8}[\"'`]?$")
#: Names that say that their value is a secret, at the end of what stands before it.
_NAMES = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|private|auth|secret|signing)[_\- ]?key|credential)s?"
_NAMED = re.compile(_NAMES + r"[\"'`\])]{0,2}[ \t]{0,8}$", re.I)
_NEAR_NAME = re.compile(_NAMES, re.I)

#: Classes of characters for transitions: lower case by letter, upper case, digits and the rest as one each.
_CLASSES = 29
_CLASS_OF = np.full(256, 28, np.uint8)
_CLASS_OF[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS_OF[ord("A") : ord("Z") + 1] = 26
_CLASS_OF[ord("0") : ord("9") + 1] = 27


def statistics(docs: DataFrame) -> dict:
    """Log probabilities of character transitions inside words, and the commonest plain words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            words: Counter = Counter()
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                codes = _CLASS_OF[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
                pairs += np.bincount(codes[:-1] * _CLASSES + codes[1:], minlength=len(pairs))
                words.update(_PLAIN.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array([-1] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())],
                names=["word", "pair", "n"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(pairs), pa.string()), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs)], names=["word", "pair", "n"]
        )

    counted = settled(
        docs.select("text").mapInArrow(count, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    )
    pairs = np.zeros(_CLASSES * _CLASSES)
    for r in counted.where("pair >= 0").collect():
        pairs[r["pair"]] = r["n"]
    table = pairs.reshape(_CLASSES, _CLASSES) + 0.5
    words = counted.where("word IS NOT NULL").select("word", "n")
    least = least_count(words, DICTIONARY)
    return {
        "transitions": np.log(table / table.sum(1, keepdims=True)),
        "words": frozenset(r["word"] for r in words.where(F.col("n") >= max(2, least)).select("word").collect()),
    }


def covered(value: str, words: frozenset) -> float:
    """Share of the characters that dictionary words cover, longest first from the left."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(16, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                inside += size
                at += size
                break
        else:
            at += 1
    return inside / len(low)


def _hashed(words: list[str]) -> list[float]:
    out = [0.0] * NEIGHBOURS
    for w in words:
        out[zlib.crc32(w.lower().encode()) % NEIGHBOURS] = 1.0
    return out


def features(value: str, before: str, after: str, known: dict) -> list[float]:
    codes = _CLASS_OF[np.frombuffer(value.encode(), np.uint8)].astype(np.int64)
    counts = np.array(list(Counter(value).values())) / len(value)
    kinds = np.maximum(codes - 25, 0)
    near = before[-1:]
    steps = known["transitions"][codes[:-1], codes[1:]]
    return [
        float(len(value)), float(-(counts * np.log2(counts)).sum()), float((kinds == 2).mean()), float((kinds == 1).mean()),
        float((kinds == 3).mean()), float((kinds[1:] != kinds[:-1]).sum() / len(kinds)),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None), float(steps.mean()) if len(steps) else 0.0,
        covered(value, known["words"]),
        float(near in "/\\~" and near != ""), float(near in "@." and near != "" or after[:1] in ("@", ".")), float(after[:1] in ("/", "\\")),
        float("//" in before[-20:]), float(near in "\"'`" and near != ""), float(_ASSIGNED.search(before) is not None),
        float(_NEAR_NAME.search(before[-30:]) is not None),
        *_hashed(_WORD.findall(before)[-2:]), *_hashed(_WORD.findall(after)[:2]),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of every candidate, in order."""
    out = {m.span() for m in _RUN.finditer(text)} | {m.span(1) for m in _USER.finditer(text)}
    for sign in _SIGN.finditer(text):
        if _NAMED.search(text[max(0, sign.start() - AROUND) : sign.start()]):
            quoted = _QUOTED.match(text, sign.end())
            if quoted:
                out.add(quoted.span(quoted.lastindex))
            elif bare := _BARE.match(text, sign.end()):
                begin = bare.start(1)
                out.add((begin, begin + len(bare[1].rstrip(".,;)]}") or bare[1])))
    return sorted(out)


def candidates(docs: DataFrame, known: dict) -> DataFrame:
    """doc_id, start, value, before, after and features of every candidate; start and length in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            owner, start, value, left, right, table = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for begin, end in spans(text or ""):
                    before, after = text[max(0, begin - AROUND) : begin], text[end : end + AROUND]
                    owner.append(i)
                    start.append(begin)
                    value.append(text[begin:end])
                    left.append(before)
                    right.append(after)
                    table.append(features(text[begin:end], before, after, known))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(owner, pa.int32())), pa.array(start, pa.int64()), pa.array(value, pa.string()),
                    pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(table, pa.list_(pa.float64())),
                ],
                names=["doc_id", "start", "value", "before", "after", "features"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, value string, before string, after string, features array<double>"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def _secret(r: random.Random) -> tuple[str, str]:
    """A made-up secret in the way that secrets are written, as (what stands before and after it, its value)."""
    letters, signs = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "!#$%&*+?@^~"
    kind = r.randrange(6)
    if kind == 0:
        value = "".join(r.choices("0123456789abcdef", k=r.choice([32, 40, 64])))
    elif kind == 1:
        value = "".join(r.choices(letters, k=r.randint(20, 48)))
    elif kind == 2:
        value = base64.b64encode(r.randbytes(r.randint(18, 48))).decode()
    elif kind == 3:
        value = r.choice(["sk_live_", "pk-", "ghx_", "AK", "xox-"]) + "".join(r.choices(letters, k=r.randint(16, 36)))
    elif kind == 4:
        value = "".join(r.choices(string.ascii_lowercase, k=r.randint(16, 32)))
    else:
        value = "".join(r.choices(signs, k=r.randint(7, 14))) + r.choice(string.digits)
    name = r.choice(["token", "secret", "password", "api_key", "access-key", "privateKey", "client_secret", "auth_token", "DB_PASSWORD", "API_KEY"])
    forms = ['{n} = "{v}"', "{n}: {v}", "{n}={v}", '"{n}": "{v}"', "{n} = '{v}'", "export {n}={v}", "{n}: `{v}`"]
    # a short password, or one letter case, is told by its name only
    forms += [] if kind in (0, 4, 5) else ["Authorization: Bearer {v}", "{v}", "my {n} {v}"]
    return r.choice(forms).replace("{n}", name), value


def _look_alike(r: random.Random, words: list[str]) -> tuple[str, str]:
    """Something that is no secret: identifiers, hashes of contents, numbers, paths, words and empty promises."""
    some = [r.choice(words) for _ in range(4)]
    digest = "".join(r.choices("0123456789abcdef", k=r.choice([32, 40, 64])))
    glued = "".join(some)
    named = r.choice(["token", "secret", "password", "api_key", "auth_token"])
    return r.choice([
        ("id: {v}", str(uuid.UUID(int=r.getrandbits(128)))), ("{v}", str(uuid.UUID(int=r.getrandbits(128)))),
        ("commit {v}", digest), ("sha256:{v}", digest), ("checksum = {v}", digest), ("{v}", str(r.randrange(10**11, 10**18))),
        ("order {v}", str(r.randrange(10**11, 10**16))), ("call {v}", f"{r.randrange(10**3)}-{r.randrange(10**4)}-{r.randrange(10**6):06}"),
        ("/usr/{v}", "/".join(some)), ("https://example.org/{v}", "/".join(some) + f"-{r.randrange(10**6)}"), ("{v}", glued), ("{v}", "_".join(some)),
        ("{v}", "-".join(some)), ("{v}()", some[0] + "".join(w.title() for w in some[1:])), ('name = "{v}"', glued), ("{v}", some[0] * 3),
        (f"{named}: " + "{v}", some[0]), (f"{named} = " + '"{v}"', f"your-{some[0]}-{named}"), (f"{named}s: " + "{v}", str(r.randrange(10**4))),
        (f"{named} = " + "{v}", f"config.{some[0]}.{named}"),
    ])


def planted(docs: DataFrame, seed: str = "1", limit: int = PLANTED) -> tuple[DataFrame, DataFrame]:
    """Pieces of documents with findings written into them (doc_id, text), and their labels (doc_id, start, length, is_secret).

    Half of the findings are secrets. They depend on the seed and on the row alone. The ids are hashes of rows.
    """
    rows = docs.where("text IS NOT NULL").select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = [], []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                r = random.Random(f"{seed}:{key}")
                first = r.randrange(max(1, len(text) - PIECE + 1))
                parts = text[first : first + PIECE].split(" ")
                words = [w for w in _PLAIN.findall(text[first : first + PIECE].lower())] or ["word"]
                cuts = sorted(r.randrange(len(parts) + 1) for _ in range(EACH))
                out, marks = " ".join(parts[: cuts[0]]), []
                for at, until in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                    secret = r.random() < 0.5
                    form, value = _secret(r) if secret else _look_alike(r, words)
                    left, right = form.split("{v}")
                    out += " " + left
                    marks.append({"start": len(out), "length": len(value), "is_secret": int(secret)})
                    out += value + right + " " + " ".join(parts[at:until])
                texts.append(out)
                labels.append(marks)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("is_secret", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.string()), pa.array(labels, kind)], names=["doc_id", "text", "labels"]
            )

    chosen = sampled(rows, limit, "doc_id").dropDuplicates(["doc_id"])
    made = settled(chosen.mapInArrow(write, "doc_id long, text string, labels array<struct<start: long, length: int, is_secret: int>>"))
    return made.select("doc_id", "text"), made.select("doc_id", F.inline("labels"))


def _keys(labelled: DataFrame) -> list[str]:
    return ["doc_id", "start"] + ["length"] * ("length" in labelled.columns)


def unmatched(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labelled findings that no candidate stands for; the forest can neither learn nor score them."""
    return labelled.join(found.withColumn("length", F.length("value")), _keys(labelled), "left_anti")


def train(found: DataFrame, labelled: DataFrame, limit: int = TRAIN):
    """A forest, or the share of secrets where the labels are all of one kind."""
    keys = _keys(labelled)
    marks = labelled.where("is_secret IS NOT NULL AND doc_id IS NOT NULL").groupBy(*keys).agg(F.max("is_secret").cast("double").alias("label"))
    rows = found.withColumn("length", F.length("value")).join(sampled(marks, limit, *keys), keys)
    # of several candidates at one start the longest is meant
    rows = rows.groupBy(*keys, "label").agg(F.max(F.struct(F.length("value"), "value", "features"))["features"].alias("features"))
    rows = rows.orderBy(*keys).select("label", array_to_vector("features").alias("vector"))
    rows = settled(rows)
    n, secrets = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < secrets < n:
        return ((secrets or 0) + 1) / (n + 2)
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird")
    return forest.fit(rows)


def scan(found: DataFrame, model) -> DataFrame:
    """The candidates with score (0 to 1) and is_secret (score of at least one half)."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))
