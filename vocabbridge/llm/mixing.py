"""Mixing sources to target weights by drawing fixed-length blocks of words.

Words are packed, source by source, into blocks of one length, ``BLOCK_WORDS`` at most; a
small source has shorter blocks, so that it still has ``LEAST_BLOCKS`` of them and its words
come near their target.  The output is
divided into shards of ``SHARD_SLOTS`` slots, one block each.  A shard gets the whole
part of each source's expected slots, and draws the rest from a multinomial over the
fractions.  A source numbers its slots through all shards; slot k takes the block that
a pseudorandom permutation of the source's blocks, another one for every pass, has at
place k modulo their number.  Slots and blocks are joined by index.

A source's target is its share of all words by weight, at most ``MOST_REPEATS`` times
its own words; what is cut off goes to the others by weight until none is above.  A
block is taken at most that often, too.  Everything is hashed or drawn from ``seed``,
so reruns agree.

Nulls and edges: a null text has no words and is never taken; the null source is a
source of its own, the last one.  Rows that repeat one ``doc_id`` are rows of their own
with equal places in the order.  No words at all give targets of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import frugal, mix as mix_bits
from vocabbridge.llm.ordered import running
from vocabbridge.operators.rowindex import contiguous_part, running_before
from vocabbridge.storage import stored

BLOCK_WORDS = 64
LEAST_BLOCKS = 256
SHARD_SLOTS = 16384
MOST_REPEATS = 3
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, number, weight, target`` from ``source, source_size``.

    One row per source.  With sources ordered by what a unit of weight may take, those
    below the common level are the ones that stop at their limit, so two running sums
    find the level.
    """
    everything = W.partitionBy(F.lit(0))
    numbered = sizes.withColumn(
        "number", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    ).withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
    limit = F.col("source_size") * MOST_REPEATS
    by_limit = W.orderBy(F.col("_limit") / F.col("weight"), "number")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    sums = (
        numbered.withColumn("_limit", limit)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_limits_before", F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    level = (F.col("_total") - F.col("_limits_before")) / (F.col("_weights") - F.col("_weights_before"))
    stops = F.col("_limit") <= F.col("weight") * level
    first_free = F.min(F.when(~F.col("_stops"), F.struct("_place", "_level"))).over(everything)["_level"]
    return (
        sums.withColumn("_level", level)
        .withColumn("_stops", stops)
        .withColumn("_place", F.row_number().over(by_limit))
        .withColumn("_common", first_free)
        .withColumn("target", F.least(F.col("_limit").cast("double"), F.col("weight") * F.coalesce("_common", "_level")))
        .select("source", "source_size", F.col("number").cast("int").alias("number"), "weight", "target")
    )


def slot_counts(targets: DataFrame) -> DataFrame:
    """``shard, number, n``: how many slots each output shard gives to each source.

    A source needs as many slots as blocks of its own length make up its target.
    """
    slots = F.col("target") * F.col("blocks") / F.col("source_size")
    rows = targets.where("target > 0").select("number", slots.alias("slots")).orderBy("number").toPandas()
    numbers, wanted = rows["number"].to_numpy(np.int32), rows["slots"].to_numpy(float)
    spark = targets.sparkSession
    total = int(round(wanted.sum()))
    shards = -(-total // SHARD_SLOTS)
    if not shards:
        return spark.createDataFrame([], "shard long, number int, n long")
    share = wanted / wanted.sum()

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                expected = share * min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                counts = np.floor(expected).astype(np.int64)
                left = expected - counts
                rest = int(round(left.sum()))
                if rest:
                    counts += np.random.default_rng([SEED, shard]).multinomial(rest, left / left.sum())
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(some.sum()), shard)), pa.array(numbers[some]), pa.array(counts[some])],
                    names=["shard", "number", "n"],
                )

    return spark.range(shards).mapInArrow(draw, "shard long, number int, n long")


def permuted(places: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of ``0..n-1``, chosen by ``key``, puts ``places``.

    The indexes fill the lines of a square.  Each round rotates every line by a hash of
    its number and then every column; the last line and the columns it does not reach
    are rotated by their own lengths.  Every step can be undone, so no index is lost.
    """
    side = max(1, int(np.ceil(np.sqrt(n))))
    x = places.astype(np.int64)

    def turn(at, lines, lengths, step):
        return (at + (hashed(lines, key, step) % lengths.astype(np.uint64)).astype(np.int64)) % lengths

    for step in (1, 2, 3, 4):
        line, column = x // side, x % side
        column = turn(column, line, np.minimum(side, n - line * side), step)
        line = turn(line, column, (n - 1 - column) // side + 1, -step)
        x = line * side + column
    return x


def hashed(values: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """64 pseudorandom bits of (value, key, step)."""
    salt = mix_bits(key.astype(np.int64).view(np.uint64) + np.uint64(step % (1 << 64)))
    return mix_bits(values.astype(np.int64).view(np.uint64) ^ salt)


def drawn_blocks(slots: DataFrame) -> DataFrame:
    """``number, block`` per slot, from runs of slots ``number, blocks, first, n``."""

    def expand(batches):
        for batch in batches:
            for number, blocks, first, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                slot = np.arange(first, min(first + n, MOST_REPEATS * blocks))
                key = np.full(len(slot), SEED * 1_000_003 + number) * MOST_REPEATS + slot // blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), number, np.int32)), pa.array(permuted(slot % blocks, blocks, key))],
                    names=["number", "block"],
                )

    return slots.select("number", "blocks", "first", "n").mapInArrow(frugal(expand), "number int, block long")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is the number of words that the mix takes from it, repeats counted.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "sizes"
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.least("source_size", F.lit(LEAST_BLOCKS)))
    targets = stored(source_targets(sizes).withColumn("blocks", blocks.cast("long")), "targets")

    counts = stored(slot_counts(targets), "slots")
    first = running_before(counts, "shard", "n", "first", ("number",))
    slots = first.join(F.broadcast(targets.select("number", "blocks")), "number")
    taken_blocks = drawn_blocks(slots).groupBy("number", "block").agg(
        F.count(F.lit(1)).alias("times")
    )

    known = F.broadcast(targets)
    numbered = sized.join(known, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", sized["source"], "size", "source_size", "target", "number", "blocks"
    )
    ordered = stored(running(numbered, ["number", "doc_id", "size"], {"start": "size"}).withColumn(
        "__row", F.monotonically_increasing_id()), "ordered")
    bases = ordered.groupBy("number").agg(F.min("start").alias("base"))
    begin = F.col("start") - F.col("base")
    spans = ordered.where("size > 0").join(F.broadcast(bases), "number").select(
        "__row", "number", "source_size", "blocks", begin.alias("begin"), (begin + F.col("size")).alias("end")
    )
    first_block, _ = contiguous_part(F.col("begin"), F.col("source_size"), F.col("blocks"))
    last_block, _ = contiguous_part(F.col("end") - 1, F.col("source_size"), F.col("blocks"))
    short = F.floor(F.col("source_size") / F.col("blocks"))

    def block_begin(block):
        """The first ``source_size - blocks * short`` blocks are one word longer."""
        return block * short + F.least(block, F.col("source_size") - F.col("blocks") * short)

    pieces = spans.withColumn("block", F.explode(F.sequence(first_block, last_block))).select(
        "__row", "number", "block",
        (F.least("end", block_begin(F.col("block") + 1)) - F.greatest("begin", block_begin(F.col("block")))).alias("words"),
    )
    taken = pieces.join(taken_blocks, ["number", "block"]).groupBy("__row").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken")
    )
    return ordered.join(taken, "__row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes its words, rounded by a hash of the id.

    Rows that repeat one ``doc_id`` get the repeats of the one with most words taken.
    """
    share = (F.col("taken") / F.greatest("size", F.lit(1))).cast("double")
    luck = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    copies = (
        mix(docs, doc_id, source, text)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.floor(share + luck)).cast("int").alias("__copies"))
        .where("__copies > 0")
    )
    joined = docs.join(copies, F.col(doc_id).eqNullSafe(F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
