"""Row positions: numbering, running totals, batches, rotation, shards, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocabbridge.storage import SMALL, stored


# Partitions whose sizes are added up in one task.
PARTS = 65536


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_idx") -> DataFrame:
    """Number the rows 0, 1, ... in the given (unique) order.

    The rows are range partitioned, sorted inside the partitions and written once
    with their partition number and place; a partition's first index is the row
    count of the partitions before it.  The broadcast table has one row per
    partition, whatever the size of the data.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    table = stored(tagged, "indexed", compression=SMALL)
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.select(F.col("_part").alias("_span"), F.col("_n").alias("_total"))
    starts = _sums_before(totals, (), PARTS).select(F.col("_span").alias("_part"), F.col("_base").alias("_start"))
    return table.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_place")).alias(name), *[F.col(c) for c in df.columns]
    )


def running_before(
    df: DataFrame, index: str, value: str, name: str, keys: tuple[str, ...] = (), span: int = 65536
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``index`` (a dense row index).

    Totals of ``span`` consecutive rows are summed up first, then totals of ``span`` of
    these, and so on until one group is left; then sums are added from the top down.  No
    task sees more than one group of one level.
    """
    grouped = df.withColumn("_span", F.floor(F.col(index) / span))
    totals = stored(grouped.groupBy(*keys, "_span").agg(F.sum(value).alias("_total")), "totals")
    inside = W.partitionBy(*keys, "_span").orderBy(index).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        grouped.withColumn(name, F.sum(value).over(inside) - F.col(value))
        .join(_sums_before(totals, keys, span), [*keys, "_span"])
        .withColumn(name, F.col(name) + F.col("_base"))
        .drop("_span", "_base")
    )


def _sums_before(totals: DataFrame, keys: tuple[str, ...], span: int) -> DataFrame:
    """``_span, _base``: per group the sum of ``_total`` over all groups before it.

    ``totals`` is stored; each level above has ``span`` times fewer rows.
    """
    framed = totals.withColumn("_parent", F.floor(F.col("_span") / span))
    inside = W.partitionBy(*keys, "_parent").orderBy("_span").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = framed.withColumn("_base", F.sum("_total").over(inside) - F.col("_total"))
    top = totals.agg(F.max("_span")).first()[0]
    if top is None or top < span:
        return local.select(*keys, "_span", "_base")
    upper = stored(
        framed.groupBy(*keys, "_parent").agg(F.sum("_total").alias("_total")).withColumnRenamed("_parent", "_span"), "totals"
    )
    above = _sums_before(upper, keys, span).select(*keys, F.col("_span").alias("_parent"), F.col("_base").alias("_above"))
    return local.join(above, [*keys, "_parent"]).select(*keys, "_span", (F.col("_base") + F.col("_above")).alias("_base"))


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def with_batch(df: DataFrame, size: int = 1000, index: str = "row_idx") -> DataFrame:
    """Number of the batch of ``size`` consecutive rows a row falls in."""
    return df.withColumn("batch", F.floor(F.col(index) / size))


def head_rows(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    """The first ``n`` rows by index; all rows if there are fewer."""
    return df.where(F.col(index) < n)


def rotate(df: DataFrame, start: int, index: str = "row_idx", name: str = "feed_idx") -> DataFrame:
    """Feed order that begins at row ``start`` and wraps around (modulo the row count)."""
    return df.withColumn(name, F.pmod(F.col(index) - F.lit(start), row_count(df)))


def strided_shard(df: DataFrame, worker: int, workers: int, index: str = "row_idx") -> DataFrame:
    """Rows ``worker``, ``worker + workers``, ... for one of several readers."""
    return df.where(F.pmod(F.col(index), F.lit(workers)) == worker)


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """The rows once per epoch; the feed order is (epoch, row index)."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def contiguous_part(index: Column, n: Column, parts: int) -> tuple[Column, Column]:
    """Split ``0..n-1`` into ``parts`` runs, the first ``n mod parts`` one longer.

    Returns the part number of ``index`` and its place inside the part.
    """
    short = F.floor(n / parts)
    longer = n - short * parts
    cut = longer * (short + 1)
    part = F.when(index < cut, F.floor(index / (short + 1))).otherwise(
        longer + F.floor((index - cut) / F.greatest(short, F.lit(1)))
    )
    start = part * short + F.least(part, longer)
    return part.cast("bigint"), (index - start).cast("bigint")
