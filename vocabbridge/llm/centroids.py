"""Centroid clustering with equal-average equal-variance search, exact in integers.

Vectors are turned into integers.  Centroids are sorted by the sum (the mean) of their
components.  A vector starts at the centroid whose sum is next to its own and scans
outward on both sides.  With S the sums, V the deviations and n the components,

    n * distance >= (S - S')^2                        (equal average)
    n * distance >= (S - S')^2 + (V - V')^2           (equal variance)

so the scan ends when the nearer side fails the first inequality against the best
distance so far, and a centroid that fails the second is passed over.  Distances are
whole numbers; equal ones go to the smaller centroid number, and bounds reject only
what is farther for certain.  Each task adds up its own vectors per cluster, so a
round shuffles one row per task, cluster and component.

Nulls and edges: vectors that are null, have another length, or hold null or non-finite
components take no part and give no row.  Fewer vectors than centroids give fewer
centroids; an empty table gives no rows.  Repeated rows are vectors of their own.  Equal
seed hashes are ordered by components.  Components of any finite size are compared
exactly, large ones with wide integers; a distance or sum beyond a 64-bit integer is
null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.storage import stored

# Components below this in size keep all sums of squares inside 64 bits.
SMALL = 1 << 25
# Sums travel in limbs of this many bits; the last limb has the sign.
LIMB = 40
# Vectors that are searched at a time.
ROWS = 8192


@dataclass
class Centroids:
    """Centroids by number, and what the search needs of them in order of their sums."""

    values: np.ndarray  # int64, or Python integers where components are large

    def __post_init__(self):
        if not fits(self.values):
            self.values = self.values.astype(object)
        self.sums = self.values.sum(axis=1)
        self.order = np.argsort(self.sums, kind="stable")
        self.deviations = deviations(self.values)


def deviations(values: np.ndarray) -> np.ndarray:
    """sqrt(n * sum of squares - square of the sum) per row, to float precision."""
    exact = values.shape[1] * (values * values).sum(axis=1) - values.sum(axis=1) ** 2
    return np.sqrt(exact.astype(np.float64))


def fits(values: np.ndarray) -> bool:
    """Whether all arithmetic on these integers stays inside 64 bits."""
    return values.dtype != object and (not values.size or max(values.max(), -values.min()) < SMALL)


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Per vector the number of the nearest centroid and the squared distance.

    The last value is how many distances were computed.
    """
    n, dims = vectors.shape
    if not (fits(vectors) and fits(centroids.values)):
        vectors, centroids = vectors.astype(object), Centroids(centroids.values.astype(object))
    order, k = centroids.order, len(centroids.order)
    sums, devs = vectors.sum(axis=1), deviations(vectors)
    sorted_sums = centroids.sums[order]
    high = np.searchsorted(sorted_sums, sums)
    low = high - 1
    best = np.full(n, -1, vectors.dtype)
    chosen = np.full(n, -1, np.int64)
    alive, computed = np.arange(n), 0
    while len(alive):
        up, down = high[alive], low[alive]
        gap_up = np.where(up < k, abs(sorted_sums[np.minimum(up, k - 1)] - sums[alive]), -1)
        gap_down = np.where(down >= 0, abs(sorted_sums[np.maximum(down, 0)] - sums[alive]), -1)
        upward = (gap_up >= 0) & ((gap_down < 0) | (gap_up <= gap_down))
        gap = np.where(upward, gap_up, gap_down)
        at = np.where(upward, up, down)
        own = best[alive]
        open_ = gap >= 0
        open_ &= (own < 0) | (gap * gap <= dims * own)  # the nearer side: beyond it all are farther
        alive, at, gap, own, upward = alive[open_], at[open_], gap[open_], own[open_], upward[open_]
        high[alive[upward]] += 1
        low[alive[~upward]] -= 1
        number = order[at]
        apart = (devs[alive] - centroids.deviations[number]) ** 2 * (1 - 1e-6)
        apart -= 1e-6 * (devs[alive] ** 2 + centroids.deviations[number] ** 2)  # what rounding may add
        bound = (gap * gap).astype(np.float64) * (1 - 1e-9) + np.maximum(apart, 0)
        near = (own < 0) | (bound <= (dims * own).astype(np.float64) * (1 + 1e-9))
        asked, number = alive[near], number[near]
        difference = vectors[asked] - centroids.values[number]
        distance = (difference * difference).sum(axis=1)
        computed += len(asked)
        held, holder = best[asked], chosen[asked]
        better = (held < 0) | (distance < held) | ((distance == held) & (number < holder))
        best[asked[better]], chosen[asked[better]] = distance[better], number[better]
    return chosen, best, computed


def whole_numbers(batch_column, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component) of list rows that all have ``dims`` finite components."""
    flat = np.asarray(batch_column.flatten(), dtype=np.float64)
    floored = np.floor(flat * scale).reshape(-1, dims)
    if floored.size and np.abs(floored).max() >= 1 << 62:
        return np.array([[int(x) for x in row] for row in floored], object).reshape(-1, dims)
    return floored.astype(np.int64)


def usable(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """The rows whose vector has ``dims`` components, none null or non-finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(vector) == dims) & ~F.coalesce(bad, F.lit(True)))


def seeds(vectors: DataFrame, k: int, salt: str, dims: int, scale: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of ``<salt>:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, "vector").limit(k).select("vector").toArrow()
    return whole_numbers(rows.column(0).combine_chunks(), dims, scale)


def _parts(batch, column: int):
    for begin in range(0, batch.num_rows, ROWS):
        yield batch.slice(begin, min(ROWS, batch.num_rows - begin))


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; empty ones stay."""
    k = len(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        table = Centroids(shared.value)
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                values = whole_numbers(part.column(0), dims, scale)
                cluster, _, _ = nearest(values, table)
                values = values if fits(values) else values.astype(object)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                held = cluster[order][first]
                sums[held] += np.add.reduceat(values[order], first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        out = []
        for number in np.flatnonzero(counts):
            out.append((number, -1, 0, int(counts[number])))
            for place in range(dims):
                left, limb = int(sums[number, place]), 0
                while not -(1 << LIMB) <= left < 1 << LIMB:
                    out.append((number, place, limb, left & ((1 << LIMB) - 1)))
                    left, limb = left >> LIMB, limb + 1
                out.append((number, place, limb, left))
        names = ["cluster", "place", "limb", "value"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    # At most k * (dims + 1) * 28 rows whatever the input: float components have 137 bits.
    rows = (
        vectors.select("vector")
        .mapInArrow(add, "cluster int, place int, limb int, value long")
        .groupBy("cluster", "place", "limb")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        .collect()
    )
    totals = {}
    for row in rows:
        key = (row.cluster, row.place)
        totals[key] = totals.get(key, 0) + (int(row.value) << (LIMB * row.limb))
    after = centroids.astype(object)
    for number in range(k):
        if count := totals.get((number, -1)):
            after[number] = [totals[number, place] // count for place in range(dims)]
    return after.astype(np.int64) if all(abs(x) < 1 << 62 for x in after.flat) else after


def long_or_null(values) -> pa.Array:
    """Integers as a long column; what does not fit is null."""
    if getattr(values, "dtype", None) != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if -(1 << 63) <= x < 1 << 63 else None for x in values], pa.int64())


def cluster(
    vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, salt: str = "2",
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector."""
    kept = usable(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")), "vector", dims)
    kept = stored(kept, "vectors")
    centroids = seeds(kept, k, salt, dims, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids, dims, scale)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, digests))

    def assign(batches):
        values, names = shared.value
        table = Centroids(values) if len(values) else None
        for batch in batches:
            for part in _parts(batch, 1):
                number, distance, _ = nearest(whole_numbers(part.column(1), dims, scale), table)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(number.astype(np.int32)), long_or_null(distance),
                        pc.take(pa.array(names, pa.string()), pa.array(number)),
                    ],
                    names=["id", "cluster", "distance", "centroid_sha256"],
                )

    kind = kept.schema["id"].dataType.simpleString()
    placed = stored(
        kept.mapInArrow(assign, f"id {kind}, cluster int, distance long, centroid_sha256 string"), "placed"
    )

    # One row per cluster, k at most; a sum is null where a distance of it is.
    known = F.count("distance") == F.count(F.lit(1))
    total = F.when(known, F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = placed.groupBy("cluster").agg(total.alias("total"))
    totals = [row.total for row in by_cluster.collect()]
    whole = None if None in totals else sum(map(int, totals))
    inertia = whole if whole is not None and whole < 1 << 63 else None
    return placed.join(F.broadcast(by_cluster), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance",
        F.expr("try_cast(total AS long)").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256",
    )
