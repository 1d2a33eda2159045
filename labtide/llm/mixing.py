"""Mixing sources to target weights: hash keys, distributed prefix sums, a cut at each source's budget.

Every document gets a random but repeatable key, a hash of its id and a seed. Inside a source the
documents are ordered by that key. A source's budget in words is met by whole passes over the source
(epochs) and a last part: the documents up to the cut in key order. The document on the cut gives
only the words that are left, so the words taken equal the budget exactly.

The running sums are made in two steps. Keys are split into ranges; the words of each (source, range)
are added up first, which a map-side combine reduces to a few rows, and the sums of the earlier ranges
are handed to each range as an offset. A source that holds a third of all rows is spread over all of
its ranges, and the number of ranges follows the number of rows.

Nulls and odd rows: a null text has size 0 and takes 0 words; a null source is a source of its own, the
last one; a null doc_id hashes as the empty text. Rows that agree in key, id and size come in the order of
a hash of their texts; each row is a document of its own. An empty table gives an empty result. Columns of the input
other than the id, text and source are passed through by `mix` and ignored by `shares`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtide.llm.common import held, settled, words

#: Sources in code point order take these weights in turn.
WEIGHTS = (3, 1, 2)
#: The mix holds this many words for each two words of input, at most `EPOCHS` times a source.
HALVES = 3
EPOCHS = 2
#: The order of documents in a source; rows equal in all of it are the same in id and text.
PLACE = ("key", "doc_id", "size", "text_hash")
#: Documents per key range; only the layout depends on it.
RANGE_ROWS = 20_000
LEAST_RANGES = 256


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _range(key: Column, ranges: Column | int) -> Column:
    """The key range of a hexadecimal key: its first 28 bits, scaled."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 28)).cast("int")


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words, mixing key and text hash of each document."""
    return docs.select(
        F.col("doc_id"), F.col("source"), F.size(words("text")).cast("long").alias("size"), _key(F.col("doc_id"), seed).alias("key"),
        F.xxhash64("text").alias("text_hash"),
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, epochs: int = EPOCHS) -> DataFrame:
    """Words to take from each source; one row per source of `totals` (source, source_size).

    A source never gives more than `epochs` times its size. What the weights would give it beyond that
    is shared among the others by weight, again and again until none is above. That fixed point is
    found directly: in order of size per weight the limited sources come first, so a source is limited
    exactly if the level reached without the ones before it still exceeds its own limit. All sums are
    of integers, so the result does not depend on the order of addition.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    # sizes per weight compared as exact fractions of the weights' common multiple
    multiple = 1
    for w in weights:
        multiple *= w
    fill = F.col("source_size") * multiple / F.col("weight")
    order = Window.orderBy(fill.cast("long"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    limit = F.lit(2 * epochs)
    summed = (
        weighed.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # twice the words left for the sources from here on, and their weight
    left = F.col("all_size") * halves - limit * F.col("size_before")
    rest = F.col("all_weight") - F.col("weight_before")
    limited = F.col("weight").cast("decimal(38,0)") * left > (limit * F.col("source_size")).cast("decimal(38,0)") * rest
    marked = summed.withColumn("limited", limited)
    taken = F.coalesce(F.sum(F.when(F.col("limited"), F.col("source_size"))).over(every), F.lit(0))
    used = F.coalesce(F.sum(F.when(F.col("limited"), F.col("weight"))).over(every), F.lit(0))
    share = (F.col("weight") * (F.col("all_size") * halves - limit * taken)).cast("double") / (2 * (F.col("all_weight") - used)).cast("double")
    return marked.select(
        "source", "source_size",
        F.when(F.col("limited"), (F.col("source_size") * epochs).cast("double")).otherwise(share).alias("target"),
    )


def shares(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole passes) and taken words of each document.

    `sized` is the frame of `sizes`, already settled: it is read three times.
    """
    counted = sized.agg(F.count(F.lit(1)).alias("rows")).first()
    ranges = max(LEAST_RANGES, -(-counted["rows"] // RANGE_ROWS))
    placed = sized.withColumn("range", _range(F.col("key"), ranges))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, halves, epochs)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    offsets = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("o_source"), F.col("o.range").alias("o_range"), "offset", "source_size", "target"
    )
    joined = placed.join(
        offsets, placed["source"].eqNullSafe(offsets["o_source"]) & (placed["range"] == offsets["o_range"])
    )
    inside = Window.partitionBy("source", "range").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return joined.select(
        "doc_id", "source", "range", "key", "size", "text_hash", "source_size", "target", passes.alias("epochs"),
        (passes * F.col("size") + part).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: one row per document that gives words, in `copies` whole copies and a first part.

    Columns of the input stay and `mix_copies`, `mix_words` (words of a partial copy) and `mix_taken` follow;
    a column of the input with such a name is replaced. Texts are not moved: a document's place needs only
    its key against its source's cut, and the cuts are one row per source.
    """
    cut = cuts(shares(settled(sizes(docs, seed)), weights))
    key, size = _key(F.col("doc_id"), seed), F.size(words("text")).cast("long")
    place = F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"), size.alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), place.alias("place"))
    joined = rows.join(cut, F.col("row.source").eqNullSafe(F.col("cut_source")), "left")
    whole_size = F.col("place.size")
    part = (
        F.when(F.col("cut_at").isNull(), 0)
        .when(F.col("place") < F.col("cut_at"), whole_size)
        .when(F.col("place").eqNullSafe(F.col("cut_at")), F.col("cut_words"))
        .otherwise(0)
        .cast("long")
    )
    full = (part == whole_size) & (part > 0)
    counted = joined.select(
        "row", whole_size.alias("size"),
        (F.coalesce(F.col("cut_epochs"), F.lit(0)) + F.when(full, 1).otherwise(0)).cast("long").alias("copies"),
        F.when(full, 0).otherwise(part).cast("long").alias("words"),
    )
    taken = (F.col("copies") * F.col("size") + F.col("words")).alias("mix_taken")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_copies", "mix_words", "mix_taken")]
    return held(counted.select(*kept, F.col("copies").alias("mix_copies"), F.col("words").alias("mix_words"), taken)).where("mix_taken > 0")


def cuts(shared: DataFrame) -> DataFrame:
    """Per source: the place of the document on the cut, the words it gives there, and the whole passes.

    Rows that are the same in id and text share the words that are left at their place evenly, in whole words: all
    together they miss the budget by less than one word each.
    """
    same = Window.partitionBy("source", "range", *PLACE)
    counted = shared.withColumn("part", F.col("taken") - F.col("epochs") * F.col("size"))
    counted = counted.withColumn("each", F.floor(F.sum("part").over(same) / F.count(F.lit(1)).over(same)).cast("long"))
    last = F.max(F.when(F.col("part") > 0, F.struct(F.struct(*PLACE).alias("at"), "each")))
    return counted.groupBy(F.col("source").alias("cut_source")).agg(last.alias("last"), F.max("epochs").alias("cut_epochs")).select(
        "cut_source", F.col("last.at").alias("cut_at"), F.col("last.each").alias("cut_words"), "cut_epochs"
    )
