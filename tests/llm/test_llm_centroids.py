"""Centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from vocabbridge.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string, id string, vector string, total int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z", 1) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims, scale=256):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        placed = assign()
        for n in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, placed, strict=True) if c == n]
            if own:
                centers[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    placed = assign()
    inertia = [sum(d for d, c in placed if c == n) for n in range(len(centers))]
    short = lambda x: x if x < 1 << 63 else None
    whole = sum(inertia) if all(short(d) is not None for d, _ in placed) else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(
        (
            (i, c, short(d), None if any(short(e) is None for e, o in placed if o == c) else short(inertia[c]),
             None if whole is None else short(whole), digests[c])
            for (i, _), (d, c) in zip(kept, placed, strict=True)
        ),
        key=repr,
    )


@pytest.mark.parametrize("size", [1.0, 1e6, 1e9, 1e30])
def test_clusters(spark, few_partitions, size):
    draw = random.Random(3)
    rows = [(n, [size * draw.gauss(n % 4, 0.3) for _ in range(6)]) for n in range(120)]
    rows += [(200, rows[5][1]), (5, rows[5][1]), (201, [0.0] * 6), (None, [size] * 6)]
    rows += [(300, None), (301, [1.0] * 5), (302, []), (303, [1.0, None] * 3), (304, [math.nan] * 6), (305, [math.inf] * 6)]
    got = centroids.cluster(table(spark, rows), 7, 3, 6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 7, 3, 6)


def test_few_and_none(spark, few_partitions):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    got = centroids.cluster(table(spark, rows), 40, 5, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 40, 5, 2)
    assert centroids.cluster(table(spark, []), 40, 5, 2).count() == 0
    assert centroids.cluster(table(spark, [(1, None), (2, [math.nan, 1.0])]), 40, 5, 2).count() == 0


def test_search_is_exact_and_skips():
    draw = np.random.default_rng(1)
    centers = draw.integers(-300, 300, (40, 16))
    centers[7] = centers[3]  # a tie
    vectors = np.concatenate([centers[draw.integers(0, 40, 3000)] + draw.integers(-9, 9, (3000, 16)), centers])
    number, distance, computed = centroids.nearest(vectors, centroids.Centroids(centers))
    full = ((vectors[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all()
    assert (distance == full.min(axis=1)).all()
    assert computed < 0.5 * full.size


def test_equal_sums_and_one_centroid():
    centers = np.array([[1, -1], [2, -2], [-2, 2], [0, 0]])
    vectors = np.array([[0, 0], [2, -2], [-2, 2], [50, -50], [1, 1]])
    number, distance, _ = centroids.nearest(vectors, centroids.Centroids(centers))
    full = ((vectors[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert number.tolist() == full.argmin(axis=1).tolist()
    number, _, _ = centroids.nearest(vectors, centroids.Centroids(centers[:1]))
    assert number.tolist() == [0] * 5
