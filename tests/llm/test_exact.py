"""Operators whose results are exact, against plain readings of their contracts on small planted inputs."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labtide.llm import decontaminate, jaccard, lines, maxent, mixing, repeats, rules
from labtide.llm.common import settled
from labtide.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(seed=5):
    """Copies, near copies, shared passages and lines, repeats, odd white space, nulls and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "ÉTÉ", "naïve", "a", "THE", "the", "of"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line, original = text(60), "Common Line Here", text(90)
    out = []
    for i in range(1, 90):
        kind = i % 9
        t = text(r.randint(0, 140))
        if kind == 0:
            t = original
        elif kind == 1:
            w = original.split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif kind == 2:
            t = f"{t}\n  {passage}\t{text(5)}"
        elif kind == 3:
            t = f"{t}\n{line.upper() if i % 2 else line}  \n\n{text(8)}"
        elif kind == 4:
            t = f"{text(3)}\x0b\x0c{t}\r\n" + "again and again and again it goes on " * r.randint(1, 5)
        elif kind == 5:
            t = passage[: r.randint(40, len(passage))]
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), len(t)))
    long = " ".join(r.choice(vocabulary) for _ in range(6000)) + " " + passage
    return [*out, (200, long, "en", "a", 1), (201, None, None, None, None), (202, "", "en", "b", 0), (203, " \t\n", "en", "b", 3), (204, "one", "en", "b", 3),
            (205, "one", "en", "c", 3), (206, "ONE", "en", "c", 3), (207, "two words", "de", "c", 9)]


DOCS = _documents()
PAIRS = [(d[0], d[1]) for d in DOCS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def test_jaccard_join(docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert found == brute.near_duplicates(PAIRS)


def test_counts_of_few_tokens_travel_as_few_bytes(docs):
    """A task sends two bytes a token at most, never more than four a counter (the small parts of a table filled the disk)."""
    r = np.random.default_rng(3)
    for counts in (r.integers(0, 2, 512), r.integers(0, 9, 512), np.eye(1, 512, 5, np.int64)[0] * 1000, np.eye(1, 512, 5, np.int64)[0] * 70_000, np.ones(512, np.int64) * 2, np.zeros(512, np.int64)):
        data = jaccard.packed_counts(counts)
        assert len(data) <= min(2 * counts.sum(), 4 * 512)
        assert jaccard.unpacked_counts(data, 512).tolist() == counts.tolist()


def test_jaccard_join_in_many_blocks(docs, monkeypatch):
    """Without the star step's help: every pair comes from trees over several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert found == brute.near_duplicates(PAIRS)


def test_trees_lose_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    sets = []
    for i in range(120):
        middle = base[(i % 6) * 300 : (i % 6) * 300 + int(r.integers(20, 300))]
        sets.append(np.unique(np.concatenate([middle[r.random(len(middle)) < 0.9], r.integers(0, 2**63, 8, dtype=np.int64).astype(np.uint64)])))
    group = pa.table({
        "doc_id": np.arange(120), "component": np.arange(120), "n": np.array([len(s) for s in sets], np.int32),
        "bits": pa.array([jaccard.bitmap(s) for s in sets], pa.binary()), "block": np.arange(120) % 2,
    })
    found = set()
    for one, two in ((0, 0), (0, 1), (1, 1)):
        part = group.filter(pa.array([b in (one, two) for b in (np.arange(120) % 2)]))
        part = part.append_column("one", pa.array([one] * len(part))).append_column("two", pa.array([two] * len(part))).append_column("key", pa.array([7] * len(part))).append_column("keys", pa.array([[7, 9]] * len(part)))
        pairs = jaccard.tree_pairs(part, 75)
        found |= set(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()))
    truth = {
        (i, j) for i in range(120) for j in range(i + 1, 120)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    }
    assert truth and truth <= found and len(found) < 120 * 119 / 4


def test_sets_of_common_tokens_still_meet():
    r = np.random.default_rng(8)
    common = np.sort(r.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64))
    for part in (0.0, 0.2, 0.5, 0.8, 1.0):
        n = 200
        shared = np.concatenate([common[: int(n * part)], r.integers(0, 2**63, n - int(n * part), dtype=np.int64).astype(np.uint64)])
        a = np.unique(np.concatenate([shared[:180], r.integers(0, 2**63, 10, dtype=np.int64).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared[20:], r.integers(0, 2**63, 10, dtype=np.int64).astype(np.uint64)]))
        assert set(jaccard.meeting_keys(a, common, 75)) & set(jaccard.meeting_keys(b, common, 75)), part


def test_common_tokens_are_counted_over_all_documents(spark):
    """A passage held only by documents that a sample of 20,000 would leave out brings none of them together."""
    ids = spark.range(24_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("place"))
    long_ones = {r.doc_id for r in ids.where("place > 850000").limit(60).collect()}
    passage = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{' '.join(f'w{i}x{j}' for j in range(120))} {passage}" if i in long_ones else f"short {i}") for i in range(24_000)]
    found = jaccard.sketches(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).where(F.col("doc_id").isin(*long_ones))
    most = found.select(F.explode("keys").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0]
    assert found.count() == 60 and most == 1


def test_components(spark):
    r = random.Random(1)
    edges = [(a, r.randrange(1, a)) for a in range(2, 60) if a % 7] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (200, 201), (201, 200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def test_substring_dedup(docs):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.without_repeats(docs, digest=True).collect()}
    assert found == brute.without_repeats(PAIRS)
    short = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs, window=6, anchor=3).collect()}
    assert short == {d: v[1] for d, v in brute.without_repeats(PAIRS, 6).items()}


def test_line_dedup(docs):
    found = {
        r.doc_id: (r.n_lines, r.n_dropped, r.sha, r.kept)
        for r in lines.with_kept_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha"), "kept").collect()
    }
    assert found == brute.line_dedup(PAIRS)
    kept = {r.doc_id: (r.text, r.n_chars) for r in lines.drop_lines(docs).collect()}
    changed = {d: v for d, v in found.items() if v[1]}
    assert changed and all(kept[d] == (v[3], len(v[3])) for d, v in changed.items()) and kept[201] == (None, None)


@pytest.mark.parametrize("block_words", [15, 100_000])
def test_decontamination(spark, docs, block_words):
    long = DOCS[6][1]
    items = [(1, " ".join(DOCS[6][1].split()[3:20])), (2, "one"), (3, "Two-words!"), (4, None), (5, ""), (6, "the of"), (7, "not in any document at all x y z q r s"),
             (None, "again and again"), (1, "again and again and again it goes on again and"), (9, DOCS[15][1]), (10, DOCS[15][1]), (11, long)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {
        r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(sorted(map(str, r["items"])))), r.n_hit > 0)
        for r in decontaminate.contamination(docs, benchmark, block_words=block_words).collect()
    }
    truth = brute.contamination(PAIRS, items)
    assert found == truth
    assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark, block_words=block_words).collect()) == sorted(d for d, v in truth.items() if not v[4])


def test_mixture(spark, docs):
    shared = mixing.shares(settled(mixing.sizes(docs))).collect()
    sizes, by_source = {d: len(brute.words(t)) for d, t in PAIRS}, {}
    for r in shared:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    goal = brute.mix_targets({s: sum(r["size"] for r in rows) for s, rows in by_source.items()})
    for s, rows in by_source.items():
        assert rows[0].target == pytest.approx(goal[s]) and sum(r.taken for r in rows) == int(rows[0].target)
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {d: r.mix_taken for d, r in mixed.items()} == {r.doc_id: r.taken for r in shared if r.taken}
    assert all(r.mix_copies * sizes[d] + r.mix_words == r.mix_taken for d, r in mixed.items())
    again = mixing.shares(settled(mixing.sizes(docs.repartition(7)))).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in shared)


def test_quality_counts(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = {r.doc_id: tuple(r[n] for n in names) for r in rules.report(docs).collect()}
    assert found == {d: brute.base_counts(t) for d, t in PAIRS}


def _plain_mcd(x):
    """The same estimate with plain numpy: two starts, concentration on distance classes, smaller determinant."""
    floors = np.diag([(rules.FLOORS[n] * rules.UNIT) ** 2 for n in rules.NAMES])
    fits = [(x.mean(0), np.cov(x.T, bias=True) + floors)]
    middle = np.median(x, 0)
    fits.append((middle, np.diag((np.median(abs(x - middle), 0) * 1.4826) ** 2) + floors))
    ended = []
    for m, c in fits:
        for _ in range(rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            kind = np.floor(np.log2(np.maximum(d, 1e-6)) * rules.CLASSES)
            order = np.sort(kind)
            edge = order[(len(x) + rules.P + 1) // 2 - 1]
            near = x[kind <= edge]
            m, c = near.mean(0), rules.HALF_FACTOR * np.cov(near.T, bias=True) + floors
        ended.append((np.linalg.det(c), m, c))
    _, m, c = min(ended, key=lambda e: e[0])
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def test_robust_distances(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 90)))
    rows = [(i, text() if i % 12 else "## $$ %% " * 20 + text().upper(), "en", "s", 0) for i in range(1, 260)]
    counted = settled(rules.slim_rows(rules.with_counts(spark.createDataFrame(rows, SCHEMA)), "doc_id"))
    found = {x.doc_id: x for x in rules.judged(counted, *rules.fit(counted)).collect()}
    plain = sorted(counted.collect(), key=lambda x: x.doc_id)
    far = _plain_mcd(np.array([[x[n] for n in rules.NAMES] for x in plain], float))
    assert np.allclose([found[x.doc_id].distance for x in plain], far, rtol=1e-6)
    assert all(found[i].kept == bool(i % 12) for i in found)


def test_each_statistic_rejects_alone(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    line = lambda size=6: " ".join(word(size) for _ in range(10))
    lines_of = lambda size=6: [line(size) for _ in range(40)]
    clean = ["\n".join(lines_of()) for _ in range(200)]
    marked = lambda part: "\n".join(" ".join(part(w) if i % 2 else w for i, w in enumerate(x.split())) for x in lines_of())
    passage = "\n".join(lines_of()[:3])
    planted = {
        "x_length": "\n".join(lines_of(18)),
        "x_symbols": marked(lambda w: w[:5] + "#"),
        "x_lines": "\n".join(f"{x}\nread more" for x in lines_of()),
        "x_repeats": "\n".join([*lines_of()[:20], "a " + passage.replace("\n", " a "), *lines_of()[:12], "b " + passage.replace("\n", " a ")]),
        "x_capitals": marked(lambda w: w[:4] + w[4:].upper()),
    }
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*clean, *planted.values()])]
    found = {x.doc_id: x for x in rules.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(x.base_failed for x in found.values()) and all(found[i].kept for i in range(len(clean)))
    assert [n for i, n in enumerate(planted, len(clean)) if found[i].kept] == []


def test_language_model(spark, docs):
    held_out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    known, rare, weights = maxent.fit(docs, train)
    found = {r.doc_id: r for r in maxent.score(docs, known, rare, weights).collect()}
    for d, (tokens, seen, total, base) in brute.unigram_base(PAIRS, held_out).items():
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, seen, total) and r.base_score == pytest.approx(base)
    gained = [found[d].score - found[d].base_score for d, _ in PAIRS if not held_out(d)]
    assert sum(gained) > 0


def test_language_model_is_a_distribution(docs, monkeypatch):
    """Classes add up to one, and so do the tokens of a class with its unseen word; with few words in the dictionary."""
    monkeypatch.setattr(maxent, "DICTIONARY", 50)
    known, rare, weights = maxent.fit(docs, F.lit(True))
    ids, classes = maxent.Ids(known), maxent._classes(known)
    assert 0 < ids.size <= 50 and rare.count() > 0
    tokens = np.arange(ids.size)
    log = maxent._log_classes(maxent._features(tokens, classes, tokens == 0), weights)
    assert np.allclose(np.exp(log).sum(1), 1, atol=1e-4)
    for c in np.unique(known["class"]):
        assert np.isclose((10 ** known["inside"][known["class"] == c]).sum(), 1)
    brute_base = brute.unigram_base(PAIRS, lambda d: False)
    for r in maxent.score(docs, known, rare, weights).collect():
        assert r.base_score == pytest.approx(brute_base[r.doc_id][3]) and r.n_known == brute_base[r.doc_id][1]


def test_frequent_words_fall_into_eight_ranges(spark):
    text = " ".join(f"w{i} " * 2**i for i in range(10))
    known, _ = maxent.vocabulary(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA), F.lit(True))
    assert len(set(known["class"].tolist())) == 8


def test_clusters_are_the_best_of_four_starts(monkeypatch):
    seeds, real = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: seeds.append(seed) or real(seed))
    maxent._mixture([(np.array([i, i + 1]), np.array([2, 3])) for i in range(20)])
    assert seeds == [0, 1, 2, 3]


def test_clusters_come_from_all_training_documents(spark, monkeypatch):
    """More documents than a sample held; every one is a member in every turn, the same in one task or several."""
    turns, real = [], maxent._sums_of_all
    monkeypatch.setattr(maxent, "_sums_of_all", lambda *given: turns.append((given[1:], real(*given))) or turns[-1][1])
    texts = [f"{'abc'[i % 3]}{i % 7} {'abc'[i % 3]}{i % 11} w{i % 13}" for i in range(4_500)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    maxent.clusters(rows, F.col("doc_id") % 9 != 0)
    assert len(turns) == maxent.TURNS
    for (log, prior, heat), (words, members, total) in (turns[0], turns[-1]):
        assert np.allclose(members.sum(1), 4_000, atol=0.01)
        alone = maxent._sums((maxent._bag(t.encode().split()) for i, t in enumerate(texts) if i % 9), log, prior, heat)
        assert np.allclose(words, alone[0], rtol=1e-3, atol=1e-2) and np.allclose(total, alone[2], rtol=1e-4)


def test_first_weights_come_from_all_training_documents(spark, docs):
    """A feature's first weight leans to what follows it in all documents."""
    known, _ = maxent.vocabulary(docs, F.lit(True))
    start = maxent.start_weights(known)
    weights = maxent.counted_weights(docs, known, start)
    ids, classes = maxent.Ids(known), maxent._classes(known)
    gained = []
    for _, text in PAIRS:
        tokens = np.append(ids.of((text or "").lower().encode().split()), ids.size + maxent.CLUSTERS)
        features = maxent._features(tokens, classes, np.arange(len(tokens)) == 0)
        before, after = (maxent._log_class(features, classes[tokens], w, maxent.Space()).sum() for w in (start, weights))
        gained.append(after - before)
    assert sum(gained) > 0
