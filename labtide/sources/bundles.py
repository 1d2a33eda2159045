"""FHIR documents read in blocks: the entries of a Bundle of any size, cut out by many tasks.

Spark reads a document as the texts between closing braces, so a document without a single line break has blocks, too.
What a brace means depends on everything before it: whether it lies in a string, how deep it is nested, and whether
the array around it is the Bundle's `entry`. All three are prefix scans over a file's blocks, one small row a
block: each block says how it turns quotes and depth, which gives every block's start; then, what it
opens last in the root and inside its members. With that known, every block cuts out its own entries. An entry
that crosses a block's end leaves pieces, which are joined by file and order.

What is left of a document without its entries, its skeleton, says whether it is a Bundle at all. In it a run of
entries is one number, so it stays small; a skeleton or an entry beyond `LONGEST` characters is cut and refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, Window
from pyspark.sql import functions as F

from labtide.session import checkpointed
from labtide.sources.records import CLOSE, OPEN, WHOLE, WITHIN, stitched

LONGEST = 1 << 24
SKELETON = 9
_SCHEMA = "file string, start long, row long, text string, part int, long boolean"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
_NAMES = ["file", "start", "row", "text", "part", "long"]
#: A string, with its closing quote if it has one, or a sign that nests; and the rest of a string. An escaped character is
#: passed over outside strings, too, so that a wrong guess about a block's start is wrong in the same way throughout.
_TOKENS = re.compile(r'\\.|"[^"\\]*(?:\\.[^"\\]*)*("?)|[{\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)


def pieces(reader: DataFrameReader, path: str | list[str]) -> DataFrame:
    """Texts between closing braces, in the order of their block."""
    return reader.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"),
    )


#: Stands for an entry in a skeleton; no character of any script.
_ENTRY = "\uffff"


class Walk:
    """Place in a document: in a string or not, depth, whether the list that the root opened last is `entry`, and whether
    what was opened last inside a member of the root is an object."""

    def __init__(self, inside: bool = False, depth: int = 0, listed: bool | None = None, object_in: bool | None = None):
        self.inside, self.depth, self.listed, self.object_in, self.key = inside, depth, listed, object_in, None

    def signs(self, text: str) -> Iterator[tuple[int, str]]:
        """Places of the signs that nest, with depth and string counted up to each; the closing brace behind the text comes last."""
        at = 0
        if self.inside:
            rest = _REST.match(text)
            if not rest[1]:
                return
            self.inside, at = False, rest.end()
        for token in _TOKENS.finditer(text, at):
            if token[0][0] == '"':
                if not token[1]:
                    self.inside = True
                    return
                if self.depth == 1:
                    self.key = token[0]
            elif token[0][0] != "\\":
                yield token.start(), token[0]
        yield len(text), "}"

    def step(self, sign: str) -> None:
        if sign == "}" or sign == "]":
            self.depth -= 1
            return
        if self.depth == 1:
            self.listed = sign == "[" and self.key == '"entry"'
        elif self.depth == 2:
            self.object_in = sign == "{"
        self.depth += 1


def _by_block(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple]:
    """(place, other columns, texts) of runs of rows of one block; a block may come in several runs."""
    for batch in batches:
        place, texts, rest = None, [], None
        for row in zip(*(batch[c].to_pylist() for c in ("file", "start", *others, "text"))):
            if row[:2] != place:
                if texts:
                    yield place, rest, texts
                place, rest, texts = row[:2], row[2:-1], []
            texts.append(row[-1])
        if texts:
            yield place, rest, texts


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run: whether quotes turn, change of depth from outside and from inside a string, bytes read."""
    for (file, start), (size,), texts in _by_block(batches, "size"):
        ends = []
        for inside in (False, True):
            walk = Walk(inside)
            for text in texts:
                for _, sign in walk.signs(text):
                    walk.depth += 1 if sign in "{[" else -1
            ends.append(walk)
        total = sum(len(text.encode()) + 1 for text in texts)
        row = (file, start, size, ends[0].inside, ends[0].depth, ends[1].depth, total)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "start", "size", "turns", "outside", "within", "bytes"])


def _before(*order: str):
    return Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def starts(reader: DataFrameReader, path: str | list[str]) -> DataFrame:
    """One row per block: file, start, inside and depth where it starts, and the file's faults of nesting (`sound`)."""
    kinds = "file string, start long, size long, turns boolean, outside long, within long, bytes long"
    runs = pieces(reader, path).mapInArrow(_turns, kinds).withColumn("run", F.monotonically_increasing_id())
    # the runs of a block follow one another in its task
    inside = F.coalesce(F.sum(F.col("turns").cast("int")).over(_before("start", "run")), F.lit(0)) % 2 == 1
    placed = runs.withColumn("inside", inside).withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    depth = F.coalesce(F.sum("change").over(_before("start", "run")), F.lit(0))
    every = Window.partitionBy("file")
    # the text behind the last brace has no brace behind it; a mark of three bytes at a file's start is not read
    behind = (F.sum("bytes").over(every) - F.col("size")).isin(1, -2)
    whole = F.sum("change").over(every) == F.when(behind, -1).otherwise(0)
    first = F.row_number().over(Window.partitionBy("file", "start").orderBy("run")) == 1
    found = placed.select("file", "start", "inside", depth.alias("depth"), whole.alias("sound"), first.alias("first"))
    return checkpointed(found.where("first").drop("first"))


def _known(blocks: DataFrame, *columns: str) -> dict:
    """Starts of blocks, for the tasks: only of those that do not start like a new document."""
    odd = blocks.where("inside OR depth != 0").select("file", "start", *columns).collect()
    return {(r["file"], r["start"]): tuple(r[c] for c in columns) for r in odd}


_MARKERS = {"file": pa.string(), "start": pa.int64(), "listed": pa.bool_(), "object_in": pa.bool_()}


def _markers(known: dict):
    """What each run of a block opens last, null for nothing."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, at = None, None
        for place, _, texts in _by_block(batches):
            if place != at:
                walk, at = Walk(*known.get(place, ())), place
            for text in texts:
                for _, sign in walk.signs(text):
                    walk.step(sign)
            row = (*place, walk.listed, walk.object_in)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _MARKERS.values())], names=list(_MARKERS))

    return mark


def parts(reader: DataFrameReader, path: str | list[str], blocks: DataFrame) -> DataFrame:
    """Entries, pieces of entries, and skeletons of the blocks that `starts` found."""
    known = _known(blocks, "inside", "depth")
    if known:
        runs = pieces(reader, path).mapInArrow(_markers(known), "file string, start long, listed boolean, object_in boolean")
        run = F.monotonically_increasing_id()
        last = runs.withColumn("run", run).groupBy("file", "start").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("run"))).alias(c) for c in ("listed", "object_in")]
        )
        around = {c: F.last(c, ignorenulls=True).over(_before("start")) for c in ("listed", "object_in")}
        known = _known(blocks.join(last, ["file", "start"], "left").withColumns(around), "inside", "depth", *around)
    return checkpointed(pieces(reader, path).mapInArrow(_cut(known), _SCHEMA))


class _Block:
    """Entries and the skeleton of one block."""

    def __init__(self, place: tuple, walk: Walk):
        self.place, self.walk, self.row, self.out = place, walk, 0, []
        self.inherited = bool(walk.listed and walk.object_in and walk.depth > 2)
        self.entry: list[str] | None = [] if self.inherited else None
        self.size = 0
        self.bones: list[str] = []
        self.weight = 0

    def _bone(self, text: str) -> None:
        if self.weight <= LONGEST and text:
            self.bones.append(text)
        self.weight += len(text)

    def _add(self, text: str) -> None:
        if self.size <= LONGEST:
            self.entry.append(text)
        self.size += len(text)

    def _gap(self, text: str) -> None:
        """What is between two entries, and the entry's own sign; a comma between two of them says nothing new."""
        gap = text.strip()
        if not (gap == "," and self.bones[-1:] == [_ENTRY]):
            self._bone(gap)
            self._bone(_ENTRY)

    def piece(self, text: str) -> None:
        walk, begun = self.walk, 0
        for at, sign in walk.signs(text):
            if sign == "{" and walk.depth == 2 and walk.listed and self.entry is None:
                self._gap(text[begun:at])
                self.entry, self.size, begun = [], 0, at
            if sign == "}" and at == len(text) and walk.depth <= 0:
                self._bone(text[begun:])  # behind the document
                walk.step(sign)
                return
            walk.step(sign)
        if self.entry is None:
            self._bone(text[begun:] + "}")
            return
        self._add(text[begun:] + "}")
        if walk.depth == 2 and not walk.inside:
            self.close(CLOSE if self.inherited else WHOLE)

    def close(self, part: int) -> None:
        self.out.append((*self.place, self.row, "".join(self.entry)[:LONGEST], part, self.size > LONGEST))
        self.row, self.entry, self.inherited = self.row + 1, None, False

    def end(self) -> list[tuple]:
        if self.entry is not None:
            self.close(WITHIN if self.inherited else OPEN)
        self.out.append((*self.place, -1, "".join(self.bones)[:LONGEST], SKELETON, self.weight > LONGEST))
        return self.out


def _cut(known: dict):
    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _KINDS)], names=_NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for place, _, texts in _by_block(batches):
            if block is None or place != block.place:
                if block:
                    yield rows(block.end())
                block = _Block(place, Walk(*known.get(place, ())))
            for text in texts:
                block.piece(text)
            if block.out:
                yield rows(block.out)
                block.out = []
        if block:
            yield rows(block.end())

    return cut


def load(reader: DataFrameReader, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(skeletons: file, value, sound) and (entries: file, position, value) of all documents.

    A skeleton is null where it had to be cut. Positions rise in a document and are not gapless.
    """
    blocks = starts(reader, path)
    found = parts(reader, path, blocks)
    bones = found.where(F.col("part") == SKELETON).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("start", "text"))).alias("bones"), F.bool_or("long").alias("long"), F.sum(F.length("text")).alias("size")
    )
    runs = F.regexp_replace(F.array_join("bones.text", ""), f"{_ENTRY}(,{_ENTRY})*", "0")
    sound = blocks.groupBy("file").agg(F.bool_and("sound").alias("sound"))
    value = F.when(~F.col("long") & (F.col("size") <= LONGEST), runs)
    skeletons = bones.select("file", value.alias("value")).join(sound, "file")
    entries = found.where(F.col("part") == WHOLE).drop("part").unionByName(stitched(found.where(F.col("part").isin(OPEN, WITHIN, CLOSE)), "", LONGEST))
    # a block holds fewer entries than bytes, so places stay in order
    text = F.when(~F.col("long"), F.col("text"))
    return skeletons, entries.select("file", (F.col("start") + F.col("row")).alias("position"), text.alias("value"))
