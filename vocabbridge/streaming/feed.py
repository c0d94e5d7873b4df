"""Training examples in feed order.

The feed is a bounded read of a stored corpus, so it is a batch DataFrame with order
columns: rotate, deal to readers, repeat, pass through or pack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.functions.sequences import has_length
from vocabbridge.operators.packing import append_end, pack_buffers, pack_repeated_buffers, shuffle_in_buffer
from vocabbridge.operators.rowindex import repeat, rotate, strided_shard


def as_examples(df: DataFrame) -> DataFrame:
    """64-bit ``input_ids`` and ``labels`` of equal content."""
    ids = F.col("input_ids").cast("array<bigint>")
    return df.withColumn("input_ids", ids).withColumn("labels", ids)


def packed_feed(blocks: DataFrame, seq_length: int) -> DataFrame:
    """Examples from rows that are packed already; any other length is an error."""
    return as_examples(blocks.withColumn("input_ids", has_length(F.col("input_ids"), seq_length)))


def wrong_lengths(blocks: DataFrame, seq_length: int) -> DataFrame:
    """Rows that :func:`packed_feed` would refuse."""
    return blocks.where(F.size("input_ids") != seq_length)


def buffered_feed(
    tokens: DataFrame,
    seq_length: int,
    limit: float,
    length: str = "n_chars",
    eos: int | None = None,
    shuffle: bool = True,
    seed: int | str = 0,
    epochs: int | None = None,
) -> DataFrame:
    """Examples packed from unpacked rows, buffer by buffer; shuffled inside the buffer.

    With ``epochs`` the corpus is repeated before buffers are filled, so a buffer may
    hold the end of one epoch and the begin of the next; ``epoch`` says where it began.
    """
    rows = tokens if eos is None else append_end(tokens, eos)
    if epochs is None:
        blocks = pack_buffers(rows, seq_length, length, limit)
    else:
        blocks = pack_repeated_buffers(rows, seq_length, length, limit, epochs)
    if shuffle:
        blocks = shuffle_in_buffer(blocks, seed)
    return as_examples(blocks)


def feed(
    df: DataFrame,
    seq_length: int,
    limit: float,
    start: int = 0,
    epochs: int = 1,
    worker: int | None = None,
    workers: int = 1,
    **options,
) -> DataFrame:
    """The whole feed: rotation, repeats, then packing or pass-through.

    Several readers each take every ``workers``-th row as it is stored.  A single
    reader packs rows that still have a length column to fill buffers with, and
    passes packed rows through.  The feed order is (epoch, row or buffer, ...).
    """
    ordered = df
    if start:
        ordered = rotate(df, start).withColumn("row_idx", F.col("feed_idx")).drop("feed_idx")
    if worker is not None:
        return repeat(as_examples(strided_shard(ordered, worker, workers)), epochs)
    if options.get("length", "n_chars") in df.columns:
        return buffered_feed(ordered, seq_length, limit, epochs=epochs, **options)
    return repeat(packed_feed(ordered, seq_length), epochs)
