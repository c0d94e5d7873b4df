"""Fixed-length training blocks cut from ordered token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocabbridge.functions.hashing import hash_order
from vocabbridge.functions.sequences import full_mask
from vocabbridge.operators.buffers import assign_buffers, repeated_buffers
from vocabbridge.operators.rowindex import contiguous_part

# Defaults of the packing step.
PACK_BATCH_ROWS = 1000
DEFAULT_BLOCK = 1024


def block_length(requested: int | None, model_maximum: int) -> int:
    """The block length in use: unset means the model maximum, at most 1,024."""
    if requested is None:
        return min(model_maximum, DEFAULT_BLOCK)
    return min(requested, model_maximum)


def append_end(tokens: DataFrame, eos: int) -> DataFrame:
    """Each sequence followed by the end id."""
    return tokens.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(eos))))


def cut_blocks(
    tokens: DataFrame, keys: list[str], order: str, block: int, keep_short: bool
) -> DataFrame:
    """Concatenate the sequences of each group in order and cut every ``block`` ids.

    A group's short tail is dropped; with ``keep_short`` a group that does not fill a
    single block keeps its one short block.  Rows are shuffled once, by group.  Each
    row then cuts itself where the blocks end, so what is put together in memory is
    one block and never a whole group.
    """
    by_group = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    length = F.size("input_ids")
    placed = (
        tokens.select(*keys, order, "input_ids")
        .where(length > 0)
        .withColumn("_start", F.sum(length).over(by_group) - length)
    )
    first = F.floor(F.col("_start") / block)
    last = F.floor((F.col("_start") + length - 1) / block)

    def piece(number: Column) -> Column:
        begin = F.greatest(number * block - F.col("_start"), F.lit(0)).cast("int")
        end = F.least((number + 1) * block - F.col("_start"), length.cast("bigint")).cast("int")
        ids = F.slice(F.col("input_ids"), begin + 1, end - begin)
        return F.struct(number.alias("block"), ids.alias("piece"))

    pieces = placed.select(*keys, order, F.inline(F.transform(F.sequence(first, last), piece)))
    blocks = pieces.groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct(order, "piece"))).alias("_pieces")
    )
    ids = F.flatten(F.transform("_pieces", lambda p: p["piece"]))
    cut = blocks.select(*keys, "block", ids.alias("input_ids"))
    full = F.size("input_ids") == block
    return cut.where(full | (F.col("block") == 0)) if keep_short else cut.where(full)


def pack(
    tokens: DataFrame, block: int, batch_rows: int = PACK_BATCH_ROWS, shards: int = 1
) -> DataFrame:
    """Blocks of each split: ``split, shard, batch, block, input_ids, attention_mask``.

    ``tokens`` holds ``split, split_idx, input_ids``.  A split is dealt to ``shards``
    contiguous parts and cut into batches of ``batch_rows`` rows inside a part; tails
    are dropped per batch.  A short only block survives, except in ``train``.
    """
    # At most a handful of splits, so the table of their sizes has a fixed bound.
    sizes = tokens.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
    shard, place = contiguous_part(F.col("split_idx"), F.col("_n"), shards)
    batched = (
        tokens.join(F.broadcast(sizes), "split")
        .withColumn("shard", shard)
        .withColumn("batch", F.floor(place / batch_rows))
    )
    blocks = cut_blocks(batched, ["split", "shard", "batch"], "split_idx", block, keep_short=True)
    return exact_train_blocks(blocks, block).withColumn(
        "attention_mask", full_mask(F.col("input_ids"))
    )


def exact_train_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """Drop training blocks of any other length."""
    return blocks.where((F.col("split") != "train") | (F.size("input_ids") == block))


def buffer_limit(block: int, chars_per_token: float, sequences: int) -> float:
    """Characters a buffer of about ``sequences`` blocks holds."""
    return block * chars_per_token * sequences


def pack_buffers(tokens: DataFrame, block: int, length: str, limit: float) -> DataFrame:
    """Blocks cut inside buffers of ``limit`` characters, short tails dropped.

    ``tokens`` holds ``row_idx, input_ids`` and the ``length`` column that fills the
    buffers: characters of the text, or ids where the input is tokenised already.
    """
    buffered = assign_buffers(tokens, length, limit)
    return cut_blocks(buffered, ["buffer"], "row_idx", block, keep_short=False)


def pack_repeated_buffers(
    tokens: DataFrame, block: int, length: str, limit: float, epochs: int
) -> DataFrame:
    """As :func:`pack_buffers` over a corpus that is read ``epochs`` times without a break.

    Adds ``epoch``, the one in which the buffer begins; a buffer runs on into the next
    epoch.  Only epochs that differ are cut, the others take over their blocks.
    """
    placed, table = repeated_buffers(tokens.select("row_idx", length), length, limit, epochs)
    rows = placed.join(tokens.select("row_idx", "input_ids"), "row_idx")
    blocks = cut_blocks(rows, ["class", "buffer"], "place", block, keep_short=False)
    # One row per epoch.
    return blocks.join(F.broadcast(table), "class").drop("class")


def shuffle_in_buffer(blocks: DataFrame, seed: int | str = 0) -> DataFrame:
    """Add ``place``: a seeded permutation of the blocks inside their buffer."""
    buffer = [c for c in ("epoch", "buffer") if c in blocks.columns]
    order = hash_order(seed, *[F.col(c) for c in buffer], F.col("block"))
    shuffled = W.partitionBy(*buffer).orderBy(order, "block")
    return blocks.withColumn("place", F.row_number().over(shuffled) - 1)
