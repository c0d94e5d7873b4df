"""Key lookups that hold up when one key carries a large share of the rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vocabbridge.storage import stored

# A table is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 64 << 20
# Elements of the arrays that are resolved together in one task, and the most keys that
# get copies: no key with fewer than one in so many rows weighs on a task.
BUCKET_ITEMS = 2_000_000
# Bytes of the columns that items come from, per item.
ITEM_BYTES = 8
HEAVY_SHARE = 1 << 21
# Keys that are expected often and go to all workers where the mapping is too large to, and
# their share of the mapping at most.
COMMON_KEYS = 1 << 20
COMMON_SHARE = 0.25
# A heavy key gets one copy per this many rows.
ROWS_PER_COPY = 1_000_000


def table_bytes(df: DataFrame) -> int:
    """Size of the rows, measured: string bytes, 8 bytes per number or array element."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.greatest(F.size(field.name), F.lit(0)) * 8 + 16
        else:
            width = width + 8
    return df.agg(F.sum(width).alias("b")).first()["b"] or 0


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: list[str],
    how: str = "left",
    limit_bytes: int = BROADCAST_BYTES,
    rows_per_copy: int = ROWS_PER_COPY,
) -> DataFrame:
    """``facts`` joined to ``dim``, which has at most a few rows per ``key``.

    A ``dim`` measured to be small is broadcast.  A larger one is shuffled, with all
    heavy fact keys dealt out over several copies of their ``dim`` rows by a hash
    of the ``spread`` columns; how many copies a key gets only moves work around.
    """
    if table_bytes(dim) <= limit_bytes:
        return facts.join(F.broadcast(dim), key, how)
    counts = stored(facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "key-counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    per_copy = max(rows_per_copy, total // HEAVY_SHARE)
    # More rows than a share of the total: at most HEAVY_SHARE keys, some 16 bytes each.
    heavy = counts.where(F.col("_rows") > per_copy).select(
        key, F.ceil(F.col("_rows") / per_copy).cast("int").alias("_copies")
    )
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_copies", F.lit(1)).cast("bigint"))
    salted_facts = facts.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt)
    last_copy = (F.coalesce("_copies", F.lit(1)) - 1).cast("bigint")
    salted_dim = dim.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last_copy))
    )
    return salted_facts.drop("_copies").join(
        salted_dim.drop("_copies"), [key, "_salt"], how
    ).drop("_salt")


def unique_keys(mapping: DataFrame) -> DataFrame:
    """``_key, _value`` of a two-column mapping: of a key's values the smallest, none null."""
    key, value = mapping.columns
    pairs = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    known = pairs.where(F.col("_key").isNotNull() & F.col("_value").isNotNull())
    return known.groupBy("_key").agg(F.min("_value").alias("_value"))


def lookup_values(
    df: DataFrame,
    items: Column,
    mapping: DataFrame,
    out: str,
    row_key: str = "row_idx",
    limit_bytes: int = BROADCAST_BYTES,
    drop: tuple[str, ...] = (),
    bucket_items: int = BUCKET_ITEMS,
) -> DataFrame:
    """Add ``out``: the array ``items`` with each element replaced by its value in ``mapping``.

    ``mapping`` has two columns, key and value; of several values of a key the smallest
    counts.  Null elements and those without a value are null in ``out``; a null array
    gives an empty one.  Columns named in ``drop`` end here, so they are not sent to the
    workers.

    A mapping measured to be small goes to the workers, which resolve whole Arrow
    batches: no shuffle.  For a larger one the rows are dealt to buckets, as they are and
    once; the different elements of each bucket are joined with the mapping, come back as
    the bucket's own dictionary, and the bucket resolves its arrays whole.  An element is in
    a bucket's dictionary once however often it occurs, so no key is heavier than the number
    of buckets, and arrays are never taken apart.  Common keys (:func:`common_keys`) are in
    no dictionary: a bounded number of them goes to the workers.
    """
    typed = unique_keys(mapping)
    framed = df.withColumn("_items", items).drop(*drop)
    kept = [c for c in framed.columns if c not in ("_items", out)]
    value_type = typed.schema["_value"].dataType
    schema = T.StructType([framed.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(value_type))])
    if table_bytes(mapping) <= limit_bytes:
        return _lookup_in_batches(framed.select(*kept, "_items"), typed, schema)
    buckets = max(1, -(-_item_count(df, framed) // bucket_items))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(row_key), F.lit(buckets)).cast("int")).repartition(buckets, "_bucket")
    # Taken out of the rows behind the shuffle: arrays of words are larger than their text.
    rows = dealt.withColumn("_items", items).select(*kept, "_items", "_bucket")
    return _lookup_in_buckets(rows, mapping, schema, buckets)


def _item_count(df: DataFrame, framed: DataFrame) -> int:
    """About how many items there are: by the size of plain columns, so none is computed for it."""
    plain = (T.StringType, T.NumericType, T.BooleanType, T.ArrayType)
    arrays = [f.dataType.elementType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if all(isinstance(f.dataType, plain) for f in df.schema.fields) and all(isinstance(t, plain[:3]) for t in arrays):
        return -(-table_bytes(df) // ITEM_BYTES)
    return framed.agg(F.sum(F.greatest(F.size("_items"), F.lit(0)))).first()[0] or 0


def common_keys(mapping: DataFrame) -> DataFrame | None:
    """The entries of a large mapping that are worth sending everywhere, as :func:`unique_keys`.

    Ids are ranks by count in a ranked vocabulary, so the entries with the smallest ids are
    taken, at most ``COMMON_SHARE`` of all.  Where ids are no ranks this only moves work.
    None if neither side of the mapping is an id, or too many entries share an id.
    """
    ids = [f.name for f in reversed(mapping.schema.fields) if isinstance(f.dataType, T.IntegralType)]
    if not ids:
        return None
    most = min(COMMON_KEYS, int(mapping.count() * COMMON_SHARE))
    common = mapping.where(F.col(ids[0]).between(0, most - 1))
    return unique_keys(common) if common.count() <= 2 * most else None


def _resolved(items: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    """A list array with each element's value, null where ``keys`` lack it."""
    offsets = pc.subtract(items.offsets, items.offsets[0]).cast(pa.int32())
    flat = items.flatten()
    return pa.ListArray.from_arrays(offsets, values.take(pc.index_in(flat, value_set=keys.cast(flat.type))))


def _lookup_in_batches(framed: DataFrame, mapping: DataFrame, schema: T.StructType) -> DataFrame:
    table = mapping.toArrow()
    shared = framed.sparkSession.sparkContext.broadcast(
        (table.column("_key").combine_chunks(), table.column("_value").combine_chunks())
    )
    names = schema.fieldNames()

    def resolve(batches):
        keys, values = shared.value
        for batch in batches:
            out = _resolved(batch.column(batch.num_columns - 1), keys, values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=names)

    return framed.mapInArrow(resolve, schema)


def _lookup_in_buckets(rows: DataFrame, mapping: DataFrame, schema: T.StructType, buckets: int) -> DataFrame:
    """``rows`` end in ``_items`` and ``_bucket``, and lie in ``buckets`` partitions by bucket."""
    names, types = schema.fieldNames(), [rows.schema["_items"].dataType.elementType, schema.fields[-1].dataType.elementType]
    key_type, value_type = (to_arrow_type(t) for t in types)
    common, known = common_keys(mapping), (pa.array([], key_type), pa.array([], value_type))
    if common is not None:
        table = common.toArrow()
        known = tuple(
            pa.concat_arrays(table.column(c).chunks).cast(t) if table.num_rows else pa.array([], t)
            for c, t in (("_key", key_type), ("_value", value_type))
        )
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def different(key, table):
        found = pc.unique(table.column("_items").combine_chunks().flatten()).drop_null()
        rest = found.filter(pc.invert(pc.is_in(found, value_set=shared.value[0].cast(found.type))))
        return pa.table({"_bucket": pa.array([key[0].as_py()] * len(rest), pa.int32()), "_key": rest.cast(key_type)})

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = (
            pa.concat_arrays([some, *(c.cast(some.type) for c in right.column(n).chunks)])
            for some, n in zip(shared.value, ("_key", "_value"), strict=True)
        )
        columns = [left.column(n) for n in range(left.num_columns - 2)]
        items = left.column(left.num_columns - 2).combine_chunks()
        return pa.Table.from_arrays([*columns, _resolved(items, keys, values)], names=names)

    # Whole rows are passed on, so both uses read the same shuffle.
    key_schema = T.StructType([T.StructField("_bucket", T.IntegerType()), T.StructField("_key", types[0])])
    wanted = rows.groupBy("_bucket").applyInArrow(different, key_schema).groupBy("_key").agg(F.collect_set("_bucket").alias("_buckets"))
    entries = wanted.join(unique_keys(mapping), "_key").select(F.explode("_buckets").alias("_bucket"), "_key", "_value")
    dictionaries = entries.repartition(buckets, "_bucket").groupBy("_bucket")
    return rows.groupBy("_bucket").cogroup(dictionaries).applyInArrow(resolve, schema)


def lookup_ids(
    df: DataFrame,
    items: Column,
    mapping: DataFrame,
    out: str,
    missing: int | None = None,
    row_key: str = "row_idx",
    limit_bytes: int = BROADCAST_BYTES,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """:func:`lookup_values` with int values.

    Elements that are null or have no value become ``missing``, or are left out if that
    is None.
    """
    key, value = mapping.columns
    typed = mapping.select(key, F.col(value).cast("int").alias(value))
    found = lookup_values(df, items, typed, out, row_key, limit_bytes, drop)
    if missing is None:
        values = F.array_compact(out)
    else:
        values = F.transform(out, lambda v: F.coalesce(v, F.lit(missing)))
    return found.withColumn(out, values)
