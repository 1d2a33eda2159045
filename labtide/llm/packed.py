"""Token ids as binary files: fixed-width bit packing, with block offsets for random access.

Every id takes the bits that the greatest id of the vocabulary needs, no more. A shard file holds its ids in blocks of
`BLOCK_IDS` packed ids (the last one shorter), each followed by one newline byte, then an index record: the offset of every
block, the place of every document among the shard's ids, the document ids, and a tail of fixed size
with the counts. All numbers are little-endian, bits run from low to high. Eight ids fill exactly `width` bytes, so numpy packs
and unpacks eight lanes at a time, whole arrays each, and any range of ids is read from the bytes of its own eights:
`Shard(buffer).ids(start, stop)` works on file content and on a memory map alike.

Documents lie in ascending order of their id over all shards: texts are range-partitioned and sorted by id, and each
task encodes its part once, whole texts, and streams the ids into one file, holding a block and the shard's index. The
bytes go through Spark's own file writer, so retried tasks and lost executors leave no half files and any store that
Spark writes to will do. `shards` holds one row per file with the ids before it: a prefix sum over as many rows as
there are files. On reading, it is broadcast only if Spark's own size check allows that, and joined by shard otherwise.

The vocabulary travels to the tasks as the tokenizer's own file, whose size is its bound. A byte-level tokenizer encodes
every run of white space with the word behind it by itself, so its tasks remember the ids of such pieces, a bounded number of them, and the library
encodes only what is new; any other tokenizer gets whole texts.

Defined cases: a null text is an empty one, a document of only the end id; documents without id come last; rows with the same id
are documents of their own, ordered by length and content, and a very common id spreads over several files.
Texts are encoded whole, and strings of special tokens in them as the library does by default. An empty table gives no
file and reads back empty. Ids of any type are stored as text and cast back on reading. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labtide.llm.common import small_batches, whole

END_ID = 0
BLOCK_IDS = 1 << 16
#: Bytes of text and documents that a shard holds, about. Files are read whole, some at a time in an executor.
SHARD_BYTES = 1 << 25
SHARD_DOCS = 1 << 20
#: Bytes of text encoded together, and bytes of ids returned together; a longer text goes alone.
_TOGETHER = 1 << 20
_RETURNED = 1 << 22
_BATCH_ROWS = 1000
#: Pieces of text whose ids a task remembers, and their greatest length in characters.
_REMEMBERED = 200_000
_SHORT = 40

_MAGIC = b"IDBLOCKS"
_TAIL = "<8sIIIIQQQ"  # magic, width, ids per block, shard, blocks, documents, ids, place of the index
_TAIL_BYTES = struct.calcsize(_TAIL)
_NO_ID = (1 << 32) - 1


#: Widths of whole bytes need no lanes.
_BYTES = {8: "u1", 16: "<u2", 32: "<u4"}


def width_of(greatest: int) -> int:
    return max(1, greatest.bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids in `width` bits each; the last byte is filled with zeros."""
    if width in _BYTES:
        return np.asarray(ids).astype(_BYTES[width]).tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for b in range(-(-(width + shift) // 8)):
            out[:, byte + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data, count: int, width: int) -> np.ndarray:
    """The first `count` ids of packed bytes, as unsigned 32-bit integers."""
    if width in _BYTES:
        return np.frombuffer(data, _BYTES[width], count=count).astype(np.uint32)
    eights = -(-count // 8)
    filled = np.zeros(eights * width, np.uint8)
    known = np.frombuffer(data, np.uint8, count=min(len(data), eights * width))
    filled[: len(known)] = known
    octets, out = filled.reshape(eights, width), np.empty((eights, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = np.zeros(eights, np.uint64)
        for b in range(-(-(width + shift) // 8)):
            value |= octets[:, byte + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class Writer:
    """One shard as records: blocks as soon as they are full, the index record at the end. A record ends with a newline."""

    def __init__(self, shard: int, width: int, block_ids: int = BLOCK_IDS):
        self.shard, self.width, self.block_ids = shard, width, block_ids
        self.waiting: list[np.ndarray] = []
        self.held = self.written = self.ids = 0
        self.offsets: list[int] = []
        self.starts: list[int] = [0]
        self.names: list[bytes | None] = []

    def _block(self, ids: np.ndarray) -> bytes:
        data = pack(ids, self.width)
        self.offsets.append(self.written)
        self.written += len(data) + 1
        return data

    def add(self, name: bytes | None, ids: np.ndarray) -> Iterator[bytes]:
        self.names.append(name)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            every = np.concatenate(self.waiting)
            full = len(every) - len(every) % self.block_ids
            for at in range(0, full, self.block_ids):
                yield self._block(every[at : at + self.block_ids])
            self.waiting, self.held = [every[full:]], len(every) - full

    def close(self) -> Iterator[bytes]:
        if not self.names:
            return
        if self.held:
            yield self._block(np.concatenate(self.waiting))
        lengths = [_NO_ID if name is None else len(name) for name in self.names]
        yield b"".join(
            [
                np.array(self.offsets, "<u8").tobytes(), np.array(self.starts, "<u8").tobytes(), np.array(lengths, "<u4").tobytes(),
                *[name for name in self.names if name],
                struct.pack(_TAIL, _MAGIC, self.width, self.block_ids, self.shard, len(self.offsets), len(self.names), self.ids, self.written),
            ]
        )


def _tail(data: bytes) -> tuple[int, ...]:
    if len(data) != _TAIL_BYTES or data[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not a file of packed ids")
    return struct.unpack(_TAIL, data)[1:]


class Shard:
    """A shard file's content, or a memory map of it."""

    def __init__(self, content):
        self.content = content
        self.width, self.block_ids, self.number, blocks, self.documents, self.count, index = _tail(bytes(content[-_TAIL_BYTES - 1 : -1]))
        self.offsets = self._numbers("<u8", index, blocks)
        self.starts = self._numbers("<u8", index + 8 * blocks, self.documents + 1)
        self._names = index + 8 * (blocks + self.documents + 1)

    def _numbers(self, kind: str, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.content, kind, count=count, offset=at)

    def names(self) -> list[bytes | None]:
        lengths = self._numbers("<u4", self._names, self.documents).astype(np.int64)
        given = lengths != _NO_ID
        ends = self._names + 4 * self.documents + np.cumsum(np.where(given, lengths, 0))
        return [bytes(self.content[e - n : e]) if g else None for e, n, g in zip(ends.tolist(), lengths.tolist(), given.tolist())]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` up to `stop`, read from the blocks they lie in."""
        parts = []
        while start < stop:
            block, first = divmod(start, self.block_ids)
            last = min(self.block_ids, first + stop - start)
            low, high = first // 8, -(-last // 8)
            data = self.content[int(self.offsets[block]) + low * self.width : int(self.offsets[block]) + high * self.width]
            parts.append(unpack(data, last - 8 * low, self.width)[first - 8 * low :])
            start += last - first
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))


def cut_at_spaces(vocabulary: str) -> bool:
    """Whether a tokenizer's file says that it encodes each run of white space and the run of other characters behind it by itself.

    That holds for byte-level pairs with their usual word pattern, in which no token goes on from a character that is no
    white space into one that is, as long as nothing else looks at the text.
    """
    said = json.loads(vocabulary)
    words = said.get("pre_tokenizer") or {}
    return (
        words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        and said.get("normalizer") is None and said.get("post_processor") is None and said.get("truncation") is None and said.get("padding") is None
        and said["model"].get("type") == "BPE" and not said["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in said.get("added_tokens", []))
    )


class Encoder:
    """The tokenizer, which sees each piece of text once: ids of short pieces are remembered, up to `_REMEMBERED` of them.
    Beyond that, those met again since they were learned stay, and the others go.

    A piece is a word with the space before it, known by the word, or anything else, known by itself behind a mark. Arrow
    finds the distinct pieces of many texts and puts their ids back in order. New
    words are handed over together, as one text with one space before each: the tokens that begin with a space then are the first
    ones of each. Signs at a word's end have tokens of their own and are taken off first, and other pieces are taken apart at
    line ends. Where the tokenizer's file does not allow cuts, every text is one piece.
    """

    def __init__(self, vocabulary: str, kind: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        self.tokenizer, self.kind, self.cuts = Tokenizer.from_str(vocabulary), np.dtype(kind), cut_at_spaces(vocabulary)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = {}
        for sign, written in _WRITTEN.items():
            self.begins[sign] = np.zeros(max(tokens.values()) + 1, bool)
            self.begins[sign][[i for token, i in tokens.items() if token.startswith(written)]] = True
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, self.kind) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], sign: str) -> Iterator[bytes]:
        """Ids of each word (no white space in it) behind one sign, a space or a line end."""
        ids = self._ids([sign + sign.join(words)])[0]
        data = ids.tobytes()
        cuts = [*(np.flatnonzero(self.begins[sign][ids]) * self.kind.itemsize).tolist(), len(data)]
        return map(data.__getitem__, map(slice, cuts, cuts[1:]))

    def _learn_words(self, words: list[str]) -> None:
        """Remember words behind a space, without the signs at their ends first."""
        known, ends = self.known, {}
        for word in words:
            if word.isalnum():
                continue
            stem = word.rstrip(_SIGNS)
            if len(stem) < len(word) and stem and stem[-1] < _LATIN_END and stem[-1].isalnum():
                ends[word] = stem
        bare = list({ends.get(word, word) for word in words}.difference(known))
        if bare:
            known.update(zip(bare, self._together(bare, " ")))
        if ends:
            tails = list({word[len(stem) :] for word, stem in ends.items()})
            ids = dict(zip(tails, (x.tobytes() for x in self._ids(tails))))
            known.update({word: known[stem] + ids[word[len(stem) :]] for word, stem in ends.items()})

    def _learn_others(self, pieces: list[str]) -> None:
        """Remember other pieces, by way of the words and lines' first words they consist of."""
        known = self.known
        parts = {piece: [_as_piece(part) for part in _RUNS(_text_of(piece))] for piece in pieces}
        new = set(itertools.chain.from_iterable(parts.values())).difference(known)
        words = [part for part in new if part[:1] != _ITSELF]
        lines = [part for part in new if part[:2] == _ITSELF + "\n" and len(part) > 2 and not _NOT_A_WORD(part[2:])]
        rest = list(new.difference(words, lines))
        if words:
            self._learn_words(words)
        if lines:
            known.update(zip(lines, self._together([part[2:] for part in lines], "\n")))
        known.update(zip(rest, (ids.tobytes() for ids in self._ids([_text_of(part) for part in rest]))))
        known.update({piece: b"".join(map(known.__getitem__, found)) for piece, found in parts.items()})

    def _learn(self, pieces: set[str]) -> None:
        """Remember the pieces that are new."""
        if len(self.known) > _REMEMBERED:
            kept = self.again if len(self.again) < _REMEMBERED // 2 else self.again & pieces
            self.known, self.again = {piece: self.known[piece] for piece in kept}, set()
        new = pieces.difference(self.known)
        self.again |= pieces.difference(new)
        words = [piece for piece in new if piece.isalnum() or not _NOT_A_WORD(piece)]
        if words:
            self._learn_words(words)
        others = list(new.difference(words))
        if others:
            self._learn_others(others)

    def _joined(self, text: str) -> bytes:
        first, *rest = re.split(r"(?<=\S) ", text)
        pieces = [_ITSELF + first, *rest]
        self._learn(set(pieces))
        return b"".join(map(self.known.__getitem__, pieces))

    def __call__(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text, little-endian, and those of `end` behind them."""
        texts = texts.cast(pa.large_string())
        if not self.cuts:
            return pa.array([ids.tobytes() + end for ids in self._ids(texts.to_pylist())], pa.large_binary())
        odd = pc.match_substring_regex(texts, _SPACES_MEET).to_numpy(zero_copy_only=False)
        # the distinct pieces of all texts; an odd text, in which not every space is a cut, counts as one without any
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        places, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        pieces, firsts = _listed(coded.dictionary), _listed(split.flatten().take(pa.array(places[:-1])))
        firsts = [_ITSELF + first for first in firsts]
        self._learn({*pieces, *firsts})
        ids = [*map(self.known.__getitem__, pieces), *map(self.known.__getitem__, firsts), end]
        for at in np.flatnonzero(odd).tolist():
            ids[len(pieces) + at] = self._joined(texts[at].as_py())
        # a text's ids are those of its first piece, its other pieces and the end, taken from the distinct ones in one go
        wanted = coded.indices.to_numpy().astype(np.int64)
        wanted[places[:-1]] = len(pieces) + np.arange(len(texts))
        taken = pa.array(ids, pa.large_binary()).take(pa.array(np.insert(wanted, places[1:], len(ids) - 1)))
        _, starts, data = taken.buffers()
        ends = np.frombuffer(starts, np.int64)[taken.offset :][places + np.arange(len(texts) + 1)]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), data])


#: How a byte-level vocabulary writes a space and a line end at the start of a token.
_WRITTEN = {" ": "\u0120", "\n": "\u010a"}
#: Marks a piece that stands for itself, by a character that no text holds; others stand behind one space.
_ITSELF = "\ud800"
#: A space behind other white space, with all the white space of the tokenizer's pattern written out.
_SPACES_MEET = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
_NOT_A_WORD = re.compile(r"\s|^$|<\||\ud800").search
_RUNS = re.compile(r"\s*\S+|\s+").findall
#: Signs that have tokens of their own behind a letter or digit, and the end of the letters this is applied to.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN_END = "\u0250"


def _listed(texts: pa.Array) -> list[str]:
    """The texts as a list, by way of numpy, which takes a fraction of the time of `to_pylist`."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _text_of(piece: str) -> str:
    return piece[1:] if piece[:1] == _ITSELF else " " + piece


def _as_piece(run: str) -> str:
    """White space with the word behind it, as a piece."""
    return run[1:] if run[:1] == " " and not _NOT_A_WORD(run[1:]) else _ITSELF + run


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows to encode together, cut where their texts reach `_TOGETHER` bytes."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Files of packed ids under `path`/files and their table under `path`/shards; `path` must be new."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        vocabulary = file.read()
    width = width_of(max(end_id, *Tokenizer.from_str(vocabulary).get_vocab(with_added_tokens=True).values()))
    kind, sent = "<u2" if width <= 16 else "<u4", spark.sparkContext.broadcast(vocabulary)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, encoder = Writer(TaskContext.get().partitionId(), width, block_ids), Encoder(sent.value, kind)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for group in _groups(batch):
                found = encoder(group["text"], end)
                for name, ids in zip(group["name"].to_pylist(), found):
                    for record in writer.add(None if name is None else name.encode(), np.frombuffer(ids.as_buffer(), kind)):
                        yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])
        for record in writer.close():
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

    texts = docs.select("doc_id", whole("text").cast("string").alias("text"))
    total, documents = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    files = max(1, -(-total // shard_bytes), -(-documents // SHARD_DOCS))
    order = [F.col("doc_id").asc_nulls_last(), F.octet_length("text"), F.xxhash64("text"), F.col("turn")]
    placed = texts.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    found = placed.select(F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(records, "record binary")
    with small_batches(spark, _BATCH_ROWS):
        # the writer passes the bytes of a string on as they are and ends each record with a newline
        found.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", 0).text(f"{path}/files")

    tails = _files(spark, path).select(F.substring("content", -_TAIL_BYTES - 1, _TAIL_BYTES).alias("tail"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = tails.mapInArrow(_counted, "shard long, documents long, ids long")
    counted.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/files").where("length > 0").select("content")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for content in batch["content"]:
            yield Shard(memoryview(content.as_buffer()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(shard, documents, ids) for *_, shard, _, documents, ids, _ in map(_tail, batch["tail"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["shard", "documents", "ids"])


def read(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, little-endian) of every document in the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            names, first = s.names(), 0
            while first < s.documents:
                # documents of about as many ids as are returned together, one at least
                last = max(first + 1, int(np.searchsorted(s.starts, int(s.starts[first]) + _RETURNED // 4, side="right")) - 1)
                ids, places = s.ids(int(s.starts[first]), int(s.starts[last])).astype("<u4"), (s.starts[first : last + 1]).astype(np.int64)
                cuts = (places - places[0]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(last - first, s.number)), pa.array([None if n is None else n.decode() for n in names[first:last]], pa.string()),
                        pa.array(places[:-1]), pa.array(np.diff(places)), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["shard", "name", "at", "n_tokens", "ids"],
                )
                first = last

    found = _files(spark, path).mapInArrow(documents, "shard long, name string, at long, n_tokens long, ids binary")
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("before"))
    return found.join(shards, "shard").select(
        F.col("name").cast(id_type).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids"
    )
