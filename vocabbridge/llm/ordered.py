"""Running totals over a total order, and fixed-size bit tables for pre-filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocabbridge.llm.blocks import frugal
from vocabbridge.storage import stored

# Bits of a pre-filter.  The table has one row per 32 bits: at most 2**19 rows of two
# ints, whatever the size of the data.
FILTER_BITS = 24


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add to each row, per entry (name: column) of ``sums``, the sum over the rows before it.

    ``order`` must be unique for results that do not depend on the partitioning.  Rows
    are range partitioned and written once with their sums inside the partition; the
    sums of whole partitions (one row each) are added when the table is read.
    """
    schema = T.StructType(list(df.schema.fields))
    for name in sums:
        schema.add(f"_{name}", "long").add(f"_{name}_own", "long")
    schema.add("_part", "integer")

    def add(batches):
        part, before = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for name, column in sums.items():
                own = np.asarray(batch.column(column).fill_null(0), dtype=np.int64)
                total = np.cumsum(own)
                columns += [pa.array(total - own + before[name]), pa.array(own)]
                names += [f"_{name}", f"_{name}_own"]
                before[name] += int(total[-1]) if len(total) else 0
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part"])

    sorted_rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    table = stored(sorted_rows.mapInArrow(frugal(add), schema), "running")
    parts = table.groupBy("_part").agg(*[F.sum(f"_{n}_own").alias(f"_{n}_part") for n in sums])
    over = W.orderBy("_part")
    starts = parts.select(
        "_part", *[(F.sum(f"_{n}_part").over(over) - F.col(f"_{n}_part")).alias(f"_{n}_start") for n in sums]
    )
    joined = table.join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_{n}_start")).alias(n) for n in sums])


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """The low ``FILTER_BITS`` bits of the hashes ``key`` as a bit table of bounded size."""
    bit = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(31)).cast("int"))
    return keys.groupBy(F.shiftright(bit, 5).cast("int").alias("__word")).agg(F.bit_or(one).alias("__bits"))


def may_contain(df: DataFrame, bits: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``_hit``: false only where ``key`` is certainly not in the table.

    The broadcast table has at most 2**19 rows by construction.
    """
    bit = key.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    tagged = df.withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 5).cast("int"))
    found = tagged.join(F.broadcast(bits), "__word", "left")
    place = F.col("__bit").bitwiseAND(F.lit(31)).cast("int")
    one = F.call_function("shiftright", F.col("__bits"), place).bitwiseAND(F.lit(1))
    return found.withColumn("__hit", F.coalesce(one == 1, F.lit(False))).drop("__bit", "__word", "__bits")
