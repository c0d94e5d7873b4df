"""Exact dedup with counting quotient filters.

Every partition puts the fingerprints of its texts into counting quotient filters, one
per range of quotients.  The filters of one range are merged without loss: both are
sorted by quotient and remainder, so their entries and counts are summed up.  Only
texts with a fingerprint counted more than once go on to a comparison of their bytes.

Nulls and edges: a null text is an empty one; empty texts are equal to each other.  A
null ``doc_id`` never beats another; a group of null ids only has a null ``keep_id`` and
its rows count as kept.  Rows that repeat one ``doc_id`` with one text are one document:
the report treats them alike, the filter returns one.  Extra columns are kept by the
filter and ignored by the report.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.ordered import bit_table, may_contain
from vocabbridge.llm.blocks import frugal
from vocabbridge.storage import stored

# A fingerprint has 64 bits.  The top RANGE_BITS say which range of quotients it is in.
RANGE_BITS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class QuotientFilter:
    """A counting quotient filter over the fingerprints of one range.

    Slots are filled by linear probing in sorted order.  ``occupied`` has a bit per
    quotient that has entries, ``run_ends`` a bit per slot that ends the entries of one
    quotient, ``remainders`` the low bits by slot.  Counts over one are kept as
    (entry, count) pairs.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints``: sorted, distinct."""
        n = len(fingerprints)
        self.quotient_bits = max(1, int(np.ceil(np.log2(max(n, 1) / 0.75 + 1))))
        self.shift = 64 - RANGE_BITS - self.quotient_bits
        low = fingerprints & np.uint64((1 << (64 - RANGE_BITS)) - 1)
        quotients = (low >> np.uint64(self.shift)).astype(np.int64)
        places = np.arange(n)
        slots = np.maximum.accumulate(quotients - places) + places
        size = max(1 << self.quotient_bits, int(slots[-1]) + 1 if n else 0)
        self.top = int(fingerprints[0] >> np.uint64(64 - RANGE_BITS)) if n else 0
        self.occupied = np.zeros(1 << self.quotient_bits, bool)
        self.occupied[quotients] = True
        self.run_ends = np.zeros(size, bool)
        self.run_ends[slots[np.append(quotients[1:] != quotients[:-1], True)] if n else []] = True
        self.remainders = np.zeros(size, np.uint64)
        self.remainders[slots] = low & np.uint64((1 << self.shift) - 1)
        many = np.flatnonzero(counts > 1)
        self.many, self.many_counts = many.astype(np.int64), counts[many].astype(np.int64)

    def to_bytes(self) -> bytes:
        used = np.flatnonzero(self._used())
        head = struct.pack(
            "<5q", self.top, self.quotient_bits, len(self.run_ends), len(used), len(self.many)
        )
        return b"".join(
            [head, np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(),
             self.remainders[used].tobytes(), self.many.tobytes(), self.many_counts.tobytes()]
        )

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        self = object.__new__(cls)
        self.top, self.quotient_bits, size, used, many = struct.unpack_from("<5q", raw)
        self.shift, at = 64 - RANGE_BITS - self.quotient_bits, 40

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        quotients = 1 << self.quotient_bits
        self.occupied = np.unpackbits(take(np.uint8, (quotients + 7) // 8))[:quotients].astype(bool)
        self.run_ends = np.unpackbits(take(np.uint8, (size + 7) // 8))[:size].astype(bool)
        self.remainders = np.zeros(size, np.uint64)
        packed = take(np.uint64, used)
        self.many, self.many_counts = take(np.int64, many), take(np.int64, many)
        self.remainders[self._used()] = packed
        return self

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, first and last slot of every run."""
        quotients, last = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        first = quotients.copy()
        first[1:] = np.maximum(quotients[1:], last[:-1] + 1)
        return quotients, first, last

    def _used(self) -> np.ndarray:
        _, first, last = self._runs()
        edges = np.zeros(len(self.run_ends) + 1, np.int64)
        edges[first] += 1
        np.subtract.at(edges, last + 1, 1)
        return np.cumsum(edges[:-1]) > 0

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        quotients, first, last = self._runs()
        quotients = np.repeat(quotients, last - first + 1).astype(np.uint64)
        low = (quotients << np.uint64(self.shift)) | self.remainders[self._used()]
        counts = np.ones(len(low), np.int64)
        counts[self.many] = self.many_counts
        return low | (np.uint64(self.top) << np.uint64(64 - RANGE_BITS)), counts


def merge_entries(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of sorted (fingerprints, counts) lists."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # a merge of sorted runs
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; empty for null.

    ``lower`` does just that on ASCII texts and is faster there.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """The 64-bit values of ``column`` that occur more than once, with their ``count``."""

    def build(batches):
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            values = np.asarray(batch.column(0), dtype=np.int64).view(np.uint64)
            if len(values):
                own = np.unique(values, return_counts=True)
                held = merge_entries([held, own]) if held else own
        if held is None:
            return
        keys, counts = held
        tops = (keys >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, tops[1:] != tops[:-1]))
        ends = np.append(cuts[1:], len(keys))
        filters = [QuotientFilter(keys[a:b], counts[a:b]).to_bytes() for a, b in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(tops[cuts].astype(np.int32)), pa.array(filters, pa.binary())], names=["range", "filter"]
        )

    def merge(table):
        held = merge_entries([QuotientFilter.from_bytes(x.as_py()).entries() for x in table.column("filter")])
        many = held[1] > 1
        return pa.table({"fp": held[0][many].view(np.int64), "count": held[1][many]})

    filters = prints.where(F.col(column).isNotNull()).select(column).mapInArrow(frugal(build), "range int, filter binary")
    return filters.groupBy("range").applyInArrow(merge, "fp long, count long")


def routed(docs: DataFrame, text: str, prints: DataFrame) -> DataFrame:
    """``docs`` with ``_norm``, ``_fp`` and ``_hit``: whether bytes must be compared.

    The filters are merged exactly; what the workers get is a bit table of fixed size
    over the repeated fingerprints.  It never misses one.  When it fills up on huge
    inputs, more texts than needed are compared, with the same result.
    """
    bits = stored(bit_table(repeated_fingerprints(prints), "fp"), "bits")
    named = docs.withColumn("__norm", normalised(F.col(text))).withColumn("__fp", F.xxhash64("__norm"))
    return may_contain(named, bits, F.col("__fp"))


def duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    normed = docs.select("doc_id", normalised(F.col("text")).alias("__norm"))
    hashes = [F.xxhash64("__norm").alias("__fp"), F.unhex(F.sha2("__norm", 256)).alias("__sha")]
    members = stored(normed.select("doc_id", *hashes), "prints")
    tagged = routed(docs, "text", members.select(F.col("__fp").alias("fp")))
    groups = (
        tagged.where("__hit")
        .groupBy("__fp", "__norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1")
        .select("__fp", F.unhex(F.sha2("__norm", 256)).alias("__sha"), "group_size", "keep_id")
    )
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return members.join(groups, ["__fp", "__sha"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without texts that repeat; of equal ones the row with the largest id stays.

    Texts that no filter counted twice stay where they are; only the others are shuffled.
    """
    prints = docs.select(F.xxhash64(normalised(F.col(text))).alias("fp"))
    tagged = routed(docs, text, prints)
    row = F.struct(*[F.col(c) for c in docs.columns])
    best = F.max_by(row, F.struct(F.col(doc_id))).alias("__row")
    compared = tagged.where("__hit").groupBy("__fp", "__norm").agg(best).select("__row.*")
    return tagged.where(~F.col("__hit")).select(*docs.columns).unionAll(compared)
