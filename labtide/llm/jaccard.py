"""N-gram Jaccard join with signature trees, and the near-duplicate groups that its links form.

A document's set holds its distinct shingles (five words, A-Z in lower case); two documents link when
100 * intersection >= 75 * union. Links are decided on whole sets; everything before only proposes pairs.

1. Sketch. One row per document: set size, set fingerprint, a bitmap of the set, and meeting keys.
   Documents with equal fingerprints are one class, represented by the smallest id.
2. Meeting keys. Key i is the token of the set that comes first in the i-th random order, so two documents
   share it with the probability of their similarity; the number of keys makes a missed link less
   likely than 1e-11, the order of a hash collision. Tokens found in a large part of the documents
   are left out of these orders, so that boilerplate brings no documents together; the bound allows for it. A
   document made largely of such tokens also takes the first quarter of its tokens as keys (rare ones
   first), where any two similar sets are certain to meet. The tokens of all documents are counted for this, in
   `COUNTERS` counters that tokens share by their hash: a rare token that shares one with a common
   token counts as common in every document alike, which costs keys, never a link.
3. Stars. Members of a key meet its smallest member; verified links are joined into components. A
   group of any number of copies takes one comparison per member. Members that are left outside meet, by each
   of their keys, another member of the key's first component.
4. Signature trees. Keys whose members are still in several components are joined by a dual traversal: leaves
   hold bitmaps of the documents, nodes the OR of their bitmaps and their range of sizes. A pair of nodes is
   dropped if even its largest possible overlap falls short. Groups beyond `BLOCK` members are split into
   blocks, and pairs of blocks are separate tasks.
5. Verified pairs of both steps give the components.

Defined cases: a null or blank text has an empty set, links with nothing and is its own component; with
fewer words than a shingle the whole sequence is one; a null doc_id has no links and a null component;
rows that repeat an id are one document in the links. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labtide.llm.common import settled, small_batches
from labtide.llm.components import components
from labtide.llm.shingling import BASES, Rolling, WordHashes, binary, chunks, mixed, powers, spaced_lower

SHINGLE = 5
SHARE = 75  # per cent of the union
#: Chance of missing a link between two sets exactly at the threshold.
MISS = 1e-11
#: Counters of tokens, those that travel together, and tasks that are summed before all are.
COUNTERS = 1 << 20
COUNTER_BLOCK = 1 << 14
COUNTER_TASKS = 64
#: The part of the documents a common token is in, and the least number.
COMMON_SHARE = 0.001
COMMON_LEAST = 10
#: Rows handed to Python at a time; a row can hold two whole texts.
BATCH_ROWS = 1000
#: A set with fewer rare tokens than this uses only its first tokens as keys; with more than the other, only random ones.
RARE_LEAST, RARE_MOST = 0.6, 0.85
BITS_LEAST, BITS_MOST = 1024, 1 << 17
#: Members of one tree, members of a leaf, and children of a node.
BLOCK = 1000
#: Members of keys that are joined in one call, at most on average.
GROUP_ROWS = 5_000
LEAF, FANOUT = 8, 4
#: Bitmap bytes compared at a time.
TRAVERSAL_BYTES = 4_000_000
#: Up to this many documents in pairs, texts are picked by broadcast ids before they are shuffled.
BROADCAST_IDS = 2_000_000

SKETCH = "doc_id long, n int, f1 long, f2 long, bits binary, keys array<long>"


def _tokens(rolling: Rolling, begin: int, n: int, shingle: int, windows: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of one document inside a chunk."""
    if not n:
        return np.zeros(0, np.uint64)
    if n < shingle:
        return rolling.runs(np.array([begin]), np.array([begin + n]))
    return np.unique(windows[begin : begin + n - shingle + 1])


def token_sets(texts: Iterable[bytes | None], hashes: WordHashes, shingle: int) -> Iterator[np.ndarray]:
    for _, words in chunks(texts, spaced_lower):
        rolling = Rolling(hashes.of([w for t in words for w in t]), BASES[0])
        windows, begin = rolling.windows(shingle), 0
        for t in words:
            yield _tokens(rolling, begin, len(t), shingle, windows)
            begin += len(t)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit per token; the length is a power of two of at least twice the size, so lengths fold onto each other."""
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (2 * len(tokens) - 1).bit_length()))
    held = np.zeros(bits, bool)
    held[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def key_count(rare: float) -> int:
    """Random keys for a set with this part of rare tokens: similar sets differ in at most 1 / (3 * rare) of them."""
    return math.ceil(math.log(1 / MISS) / math.log(3 * rare))


_ORDERS = powers(BASES[0], 64)[1:] | np.uint64(1)


def meeting_keys(tokens: np.ndarray, common: np.ndarray, share: int) -> np.ndarray:
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.searchsorted(common, tokens)
    is_common = np.zeros(n, bool) if not len(common) else common[np.minimum(at, len(common) - 1)] == tokens
    light = tokens[~is_common]
    rare = len(light) / n
    parts = []
    if rare >= RARE_LEAST:
        count = key_count(rare)
        first = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(light), 10_000):
            first = np.minimum(first, (light[at : at + 10_000] * _ORDERS[:count, None]).min(1))
        parts.append(mixed(first + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(BASES[1])))
    if rare < RARE_MOST:
        prefix = n - -(-share * n // 100) + 1
        parts.append(np.concatenate([np.sort(light), np.sort(tokens[is_common])])[:prefix])
    return np.unique(np.concatenate(parts))


def _counters(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A block of counters: the place of each count as 16 bits, once for every one, or four bytes a counter if that is less."""
    if counts.sum() < 2 * len(counts):
        return np.repeat(np.arange(len(counts), dtype="<u2"), counts).tobytes()
    return np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes()


def unpacked_counts(data, block: int) -> np.ndarray:
    """The counters of a block; four bytes a counter are the greatest length."""
    if len(data) == 4 * block:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.bincount(np.frombuffer(data, "<u2"), minlength=block)


def common_counters(docs: DataFrame, shingle: int) -> np.ndarray:
    """Whether each counter's tokens are in a large part of all documents. They change the cost of the join, not its links."""
    least = max(COMMON_LEAST, COMMON_SHARE * docs.count())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, counts = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = [*token_sets(binary(batch["text"]), hashes, shingle)]
            if found:
                counts += np.bincount(_counters(np.concatenate(found)), minlength=COUNTERS)
        if counts.any():
            blocks, part = COUNTERS // COUNTER_BLOCK, TaskContext.get().partitionId() // COUNTER_TASKS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, part, np.int32)),
                    pa.array([packed_counts(x) for x in counts.reshape(blocks, -1)], pa.binary()),
                ],
                names=["block", "part", "counts"],
            )

    def summed(group: pa.Table) -> np.ndarray:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for counts in group["counts"]:
            total += unpacked_counts(counts.as_buffer(), COUNTER_BLOCK)
        return total

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"block": group["block"].slice(0, 1), "counts": pa.array([packed_counts(summed(group))], pa.binary())})

    def marked(group: pa.Table) -> pa.Table:
        total = summed(group)
        # what many rare tokens together bring to each counter is no common token
        marks = total >= least + 2 * total.mean()
        return pa.table({"block": group["block"].slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "block int, part int, counts binary").groupBy("block", "part").applyInArrow(added, "block int, counts binary")
    out = np.zeros(COUNTERS, bool)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        for r in parts.groupBy("block").applyInArrow(marked, "block int, marks binary").collect():
            out[r["block"] * COUNTER_BLOCK : (r["block"] + 1) * COUNTER_BLOCK] = np.unpackbits(np.frombuffer(bytes(r["marks"]), np.uint8))
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Size, fingerprint, bitmap and meeting keys of each document's set (no keys without an id), settled."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(common_counters(plain, shingle))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), sent.value
        for batch in batches:
            n, f1, f2, bits, keys = [], [], [], [], []
            for has_id, tokens in zip(batch["doc_id"].is_valid().to_pylist(), token_sets(binary(batch["text"]), hashes, shingle)):
                n.append(len(tokens))
                f1.append(mixed(tokens + np.uint64(BASES[0])).sum(dtype=np.uint64))
                f2.append(mixed(tokens ^ np.uint64(BASES[1])).sum(dtype=np.uint64))
                bits.append(bitmap(tokens) if len(tokens) else None)
                common = tokens[held[_counters(tokens)]]
                keys.append(meeting_keys(tokens, common, share).view(np.int64) if has_id else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(n, pa.int32()), pa.array(np.array(f1, np.uint64).view(np.int64)),
                    pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "f1", "f2", "bits", "keys"],
            )

    with small_batches(docs.sparkSession, BATCH_ROWS):
        return settled(plain.mapInArrow(sketch, SKETCH))


def verified(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, settled. `pairs` is settled and distinct."""
    ids = settled(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            a_ids = batch["a"].to_pylist()
            for a, text_a, text_b in zip(a_ids, binary(batch["text_a"]), binary(batch["text_b"])):
                if last[0] != (a, text_a):
                    last = ((a, text_a), next(token_sets([text_a], hashes, shingle)))
                left, right = last[1], next(token_sets([text_b], hashes, shingle))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= share * (len(left) + len(right) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the many texts travel to the few that they are compared with, sorted by these
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return settled(joined.mapInArrow(check, "a long, b long"))


def _fold(bits: np.ndarray, to: int) -> np.ndarray:
    """Rows of a bitmap, folded by OR onto `to` bytes."""
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _may_link(na, nb, bits_a: np.ndarray, bits_b: np.ndarray, share: int) -> np.ndarray:
    """Whether documents of na and nb tokens can link: each bit that the other lacks is a token it lacks."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64)
    overlap = np.minimum(na - only_a, nb - only_b)
    return 100 * overlap >= share * (na + nb - overlap)


def _nodes_may_link(a: tuple, b: tuple, share: int) -> np.ndarray:
    """Whether any member of node a can link to any member of node b.

    Sizes: of two linked sets the smaller has at least `share` per cent of the larger. Overlap: a member of
    a has at least `fewest` bits, and only those that both ORs hold can be in a member of b; the rest are
    tokens outside it, of which a link leaves a set at most (100 - share) per cent of its own size.
    """
    (high_a, low_a, few_a, bits_a), (high_b, low_b, few_b, bits_b) = a, b
    shared = np.bitwise_count(bits_a & bits_b).sum(-1, dtype=np.int64)
    return (
        (100 * high_a >= share * low_b) & (100 * high_b >= share * low_a)
        & (100 * (few_a - shared) <= (100 - share) * high_a) & (100 * (few_b - shared) <= (100 - share) * high_b)
    )


class Tree:
    """Documents sorted by size, their bitmaps in groups with the OR of each group above, up to one root."""

    def __init__(self, n: np.ndarray, least: np.ndarray, bits: np.ndarray):
        self.levels = [(n, n, least, bits)]  # largest size, smallest size, fewest bits of a member, OR
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            high, low, fewest, held = self.levels[-1]
            starts = np.arange(0, len(high), width)
            self.levels.append((
                np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts), np.minimum.reduceat(fewest, starts),
                np.bitwise_or.reduceat(held, starts, axis=0),
            ))
            width = FANOUT

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent positions and children of the nodes of a level above 0."""
        width, size = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][0])
        first = nodes * width
        count = np.minimum(first + width, size) - first
        parent = np.repeat(np.arange(len(nodes)), count)
        return parent, np.repeat(first, count) + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)


def dual_traversal(left: Tree, right: Tree, share: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of document pairs that the bounds can't rule out; of a tree with itself each pair once."""
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        one, two = left.levels[la], right.levels[lb]
        step = max(1, TRAVERSAL_BYTES // one[3].shape[1])
        keep = [np.zeros(0, bool)]
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            if la or lb:
                keep.append(_nodes_may_link([v[x] for v in one], [v[y] for v in two], share))
            else:
                keep.append(_may_link(one[0][x], two[0][y], one[3][x], two[3][y], share))
        kept = np.concatenate(keep)
        a, b = a[kept], b[kept]
        if not (la or lb):
            break
        if la >= lb:
            parent, a = left.children(la, a)
            b, la = b[parent], la - 1
        else:
            parent, b = right.children(lb, b)
            a, lb = a[parent], lb - 1
        if same and la == lb:
            once = a <= b
            a, b = a[once], b[once]
    if same:
        a, b = a[a < b], b[a < b]
    return a, b


def _tree(rows: dict, at: np.ndarray, width: int) -> Tree:
    bits = np.stack([_fold(rows["bits"][i], width) for i in at])
    return Tree(rows["n"][at], np.bitwise_count(bits).sum(-1, dtype=np.int64), bits)


def _sharp(rows: dict, i: int, j: int, share: int) -> bool:
    """The bound of a pair of documents by the longest bitmaps that both have."""
    a, b = rows["bits"][i], rows["bits"][j]
    width = min(len(a), len(b))
    return bool(_may_link(rows["n"][i], rows["n"][j], _fold(a, width), _fold(b, width), share))


def tree_pairs(group: pa.Table, share: int) -> pa.Table:
    """Candidate pairs of every (key, one, two) in the group: inside a block, or between two blocks, of a key's documents."""
    key, one, two, block, doc, part, n = (
        group[c].to_numpy() for c in ("key", "one", "two", "block", "doc_id", "component", "n")
    )
    rows = {"n": n.astype(np.int64), "bits": [np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()]}
    keys = group["keys"].combine_chunks()
    keys = np.split(keys.flatten().to_numpy(), keys.offsets.to_numpy()[1:-1] - keys.offsets.to_numpy()[0])
    order = np.lexsort((n, two, one, key))
    new = (key[order][1:] != key[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for members in np.split(order, np.flatnonzero(new) + 1):
        if len(members) > 1:
            x, y = _joined(rows, members, block[members] == one[members], one[members[0]] == two[members[0]], share)
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
            # a pair that shares several keys is left to the first of them
            own = np.array([np.intersect1d(keys[i], keys[j])[0] == key[members[0]] for i, j in zip(x, y)], bool)
            x, y = x[own], y[own]
            sharp = np.array([_sharp(rows, i, j, share) for i, j in zip(x, y)], bool)
            left.append(doc[x[sharp]])
            right.append(doc[y[sharp]])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _joined(rows: dict, members: np.ndarray, in_one: np.ndarray, same: bool, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs left by the trees of the members' two blocks, or of one block with itself."""
    if same and len(members) == 2:
        return members[:1], members[1:]
    one, two = members[in_one], members[~in_one]
    if not len(one) or not (same or len(two)):
        return members[:0], members[:0]
    width = min(len(rows["bits"][i]) for i in members)
    left = _tree(rows, one, width)
    right = left if same else _tree(rows, two, width)
    x, y = dual_traversal(left, right, share, same)
    return one[x], (one if same else two)[y]


def _members(sketch: DataFrame) -> DataFrame:
    return sketch.select(F.explode("keys").alias("key"), "doc_id", "n")


def links(docs: DataFrame, sketch: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Verified links (a < b) between classes of equal sets that together join every component.

    `sketch` is settled. Classes are named by their smallest id.
    """
    held = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = held.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    named = held.join(classes.select("doc_id"), "doc_id", "left_semi")
    named = settled(named.dropDuplicates(["doc_id"]).select("doc_id", "n", "bits", "keys"))
    # a key that one document holds joins nothing; most keys are such, and only the others go on
    every = _members(named)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("found")).where("found > 1").select("key")
    members = settled(every.join(shared, "key", "left_semi"))

    def starred(rows: DataFrame, centre: DataFrame) -> DataFrame:
        """Verified links of rows to the centre (key, a, n_a) of their key."""
        near = (100 * F.col("n") >= share * F.col("n_a")) & (100 * F.col("n_a") >= share * F.col("n"))
        pairs = rows.join(centre, "key").where((F.col("doc_id") != F.col("a")) & near)
        pairs = pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
        return verified(settled(pairs), docs, shingle, share)

    def still_apart(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components so far, and the keys that hold several, with the first of them."""
        joined = settled(components(known)).withColumnRenamed("node", "doc_id")
        part = F.coalesce("component", "doc_id").alias("component")
        placed = members.join(joined, "doc_id", "left").select("key", "doc_id", "n", part)
        ends = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("found")
        )
        return placed, ends.where("low < high").select("key", "low", F.ceil(F.col("found") / BLOCK).cast("int").alias("blocks"))

    lead = members.groupBy("key").agg(F.min(F.struct("doc_id", F.col("n").alias("n"))).alias("lead"))
    first = starred(members, lead.select("key", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("n_a")))
    # documents left outside the first component of a key meet one of its members, another one by every key: a
    # document with many links into a large component finds one of them here, and not by pairs with all of it
    placed, open_keys = still_apart(first)
    known = placed.join(open_keys.select("key", "low"), "key")
    centre = known.where("component = low").groupBy("key").agg(
        F.min_by(F.struct("doc_id", F.col("n").alias("n")), F.xxhash64("doc_id", "key")).alias("lead")
    )
    centre = centre.select("key", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("n_a"))
    first = first.unionByName(starred(known.where("component > low").select("key", "doc_id", "n"), centre))

    placed, open_keys = still_apart(first)
    opened = placed.join(open_keys, "key").join(named.select("doc_id", "bits", "keys"), "doc_id")
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")
    spread = opened.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    # many small keys share a task's group; the number of groups follows the rows
    groups = max(1, named.count() * key_count(1.0) // GROUP_ROWS)
    found = spread.groupBy(F.pmod(F.xxhash64("key", "one", "two"), F.lit(groups)).alias("group")).applyInArrow(
        lambda group: tree_pairs(group, share), "a long, b long"
    )
    second = verified(settled(found.distinct()), docs, shingle, share)
    return first.unionByName(second)


_TEXT = "text_hash"


def _numbered(docs: DataFrame) -> DataFrame | None:
    """Rows of different id or text with numbers of their own, if any id has several texts; null if ids tell texts apart."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias(_TEXT))
    several = rows.groupBy("doc_id").agg(F.min(_TEXT).alias("low"), F.max(_TEXT).alias("high")).where("low < high")
    if several.isEmpty():
        return None
    return settled(rows.dropDuplicates(["doc_id", _TEXT]).withColumn("number", F.monotonically_increasing_id()))


def _found_by_number(numbered: DataFrame, shingle: int, share: int) -> DataFrame:
    """doc_id, text hash, n_shingles, and the smallest (doc_id, text hash) of the row's component."""
    found = settled(_near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), shingle, share))
    rows = found.withColumnRenamed("doc_id", "number").join(numbered.select("number", "doc_id", _TEXT), "number")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", _TEXT)).alias("first"))
    return rows.join(first, "component_id").select("doc_id", _TEXT, "n_shingles", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Where rows of one id have different texts, links join rows, and each row has the smallest id of its own component.
    """
    numbered = _numbered(docs)
    if numbered is None:
        return _near_duplicates(docs, shingle, share)
    found = _found_by_number(numbered, shingle, share).select("doc_id", _TEXT, "n_shingles", F.col("first.doc_id").alias("component_id"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias(_TEXT))
    known = rows.where("doc_id IS NOT NULL").join(found, ["doc_id", _TEXT]).select("doc_id", "n_shingles", "component_id")
    return known.unionByName(_near_duplicates(rows.where("doc_id IS NULL").select("doc_id", "text"), shingle, share))


def _near_duplicates(docs: DataFrame, shingle: int, share: int) -> DataFrame:
    """The same where an id has one text only."""
    sketch = sketches(docs, shingle, share)
    joined = components(links(docs, sketch, shingle, share))
    classes = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("named"))
    classes = classes.join(joined.withColumnRenamed("node", "named"), "named", "left").select(
        "f1", "f2", F.coalesce("component", "named").alias("found")
    )
    kind = dict(docs.dtypes)["doc_id"]
    filled = sketch.where("n > 0").join(classes, ["f1", "f2"], "left").select("doc_id", "n", "found")
    empty = sketch.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("found"))
    return filled.unionByName(empty).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.col("found")).cast(kind).alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """The documents that are alone or the smallest id of their group, once each; rows without id all stay.

    Of rows that share an id but not the text, each is judged with its own text.
    """
    numbered = _numbered(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("kept_id"), F.xxhash64("text").alias(_TEXT))
    if numbered is None:
        found = _near_duplicates(docs, shingle, share)
        stay, key = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct(), ["kept_id"]
    else:
        found = _found_by_number(numbered, shingle, share)
        own = F.struct("doc_id", _TEXT)
        stay, key = found.where(own == F.col("first")).select(F.col("doc_id").alias("kept_id"), _TEXT), ["kept_id", _TEXT]
    kept = rows.where("kept_id IS NOT NULL").join(stay, key)
    once = kept.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("row.text")))).where("turn = 1")
    out = once.select("row").unionByName(rows.where("kept_id IS NULL").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
