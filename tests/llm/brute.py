"""Plain readings of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return SPACED.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, n=5):
    w = words(ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_duplicates(docs, share=75):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def without_repeats(docs, window=50):
    first = {}
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def line_dedup(docs, documents=10):
    key = lambda line: ascii_lower(line).strip(" \t\n\x0b\x0c\r")
    found = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < documents]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept))
    return out


def contamination(docs, items, window=10):
    sought = []
    for item, text in items:
        w = ALNUM.findall(ascii_lower(text or ""))
        n = min(window, len(w))
        sought += [(item, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = {}
    for d, t in docs:
        w = ALNUM.findall(ascii_lower(t or ""))
        hit, ids = set(), set()
        for item, s in sought:
            for i in range(len(w) - len(s) + 1):
                if w[i : i + len(s)] == s:
                    hit |= set(range(i, i + len(s)))
                    ids.add(item)
        ids.discard(None)
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit))
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)


def unigram_base(docs, held_out):
    """doc_id -> (n_tokens, n_known, train_tokens, base score)."""
    tokens = {d: [*words(ascii_lower(t or "")), None] for d, t in docs}
    counts = Counter(x for d, ts in tokens.items() if not held_out(d) for x in ts)
    total, kinds = sum(counts.values()), len(counts)
    score = lambda x: math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1)))
    return {d: (len(ts), sum(counts[x] > 0 for x in ts), total, sum(map(score, ts))) for d, ts in tokens.items()}


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target, sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = defaultdict(float), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return dict(target)
