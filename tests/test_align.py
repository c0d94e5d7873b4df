import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vocabbridge.functions.vectors import cosine, l2_normalise
from vocabbridge.operators import align as A
from pyspark.sql import functions as F

VECTORS = "token string, ord bigint, vector array<double>"


def vectors(spark, rows):
    return spark.createDataFrame([(str(t), n, [float(x) for x in v]) for n, (t, v) in enumerate(rows)], VECTORS)


def gold_table(spark, rows):
    return spark.createDataFrame(rows, "tgt_id int, src_id int")


def test_zero_vectors_and_unknown_tokens_are_not_usable(spark):
    df = vectors(spark, [("<unk>", [1, 0]), ("unk", [1, 0]), (4, [0, 0]), ("<pad>", [1, 1]), (5, [3, 4])])
    got = A.usable_vectors(df).collect()
    assert [(r.id, r.vector) for r in got] == [(5, [0.6, 0.8])]


def test_first_of_equal_scores_wins(spark):
    target = A.usable_vectors(vectors(spark, [(0, [1, 0])]))
    source = A.usable_vectors(vectors(spark, [(7, [0, 1]), (9, [2, 0]), (3, [5, 0])]))
    for rows in (1, 2, 100):
        assert A.nearest(target, source, block_rows=rows).first().src_id == 9


def test_unknown_winner_is_passed_over(spark):
    target = A.usable_vectors(vectors(spark, [(0, [1, 0])]))
    source = A.usable_vectors(vectors(spark, [("<unk>", [1, 0]), ("unk", [1, 0.1]), (7, [1, 0.2]), (8, [0, 1])]))
    assert A.nearest(target, source).first().src_id == 7


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000), rows=st.sampled_from([1, 3, 8, 50]), k=st.sampled_from([1, 3]))
def test_blocks_do_not_change_the_result(spark, seed, rows, k):
    rng = np.random.default_rng(seed)
    t, s = rng.integers(-2, 3, (9, 3)), rng.integers(-2, 3, (11, 3))
    t[:, 0] += 5
    s[:, 0] += 5
    target = spark.createDataFrame([(n, n, v.tolist()) for n, v in enumerate(t.astype(float))], "id int, ord bigint, vector array<double>")
    source = spark.createDataFrame([(n, n, v.tolist()) for n, v in enumerate(s.astype(float))], "id int, ord bigint, vector array<double>")
    got = A.nearest(target, source, k=k, block_rows=rows).orderBy("tgt_id", "rank").collect()
    order = np.argsort(-(t @ s.T), axis=1, kind="stable")[:, :k]
    assert [r.src_id for r in got] == order.ravel().tolist()


def test_relative_scores_are_products_unless_cosine(spark):
    target = spark.createDataFrame([(0, 0, [1.0, 1.0])], "id int, ord bigint, vector array<double>")
    source = spark.createDataFrame(
        [(0, 0, [1.0, 1.0]), (1, 1, [9.0, 0.0])], "id int, ord bigint, vector array<double>"
    )
    assert A.nearest(target, source).first().src_id == 1
    assert A.nearest(target, source, metric="cosine").first().src_id == 0
    with pytest.raises(ValueError):
        A.nearest(target, source, metric="euclid")


def test_pivots_need_both_vectors(spark):
    target = A.usable_vectors(vectors(spark, [(n, [1, n]) for n in range(6)]))
    source = A.usable_vectors(vectors(spark, [(n, [1, n]) for n in range(0, 6, 2)]))
    gold = gold_table(spark, [(n, n) for n in range(9)])
    got = A.choose_pivots(gold, target, source, 10)
    assert {r.tgt_id for r in got.collect()} == {0, 2, 4}
    assert sorted(r["rank"] for r in got.collect()) == [0, 1, 2]
    two = A.choose_pivots(gold, target, source, 2).collect()
    assert len(two) == 2
    with pytest.raises(ValueError, match="no gold pair"):
        A.relative_vectors(target, A.choose_pivots(gold.where("tgt_id > 6"), target, source), "tgt_id")


def test_relative_vectors_both_ways(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(20, 4))
    side = A.usable_vectors(vectors(spark, list(enumerate(data))))
    pivots = A.choose_pivots(gold_table(spark, [(n, n) for n in range(20)]), side, side, 7).cache()
    near = A.relative_vectors(side, pivots, "tgt_id").orderBy("id").collect()
    far = A.relative_vectors(side, pivots, "tgt_id", limit_bytes=0, block_rows=3).orderBy("id").collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    chosen = [r.tgt_id for r in pivots.orderBy("rank").collect()]
    for rows in (near, far):
        assert np.allclose([r.vector for r in rows], unit @ unit[chosen].T)


def test_gold_then_vector_then_random(spark):
    best = spark.createDataFrame([(0, 5), (1, 6)], "tgt_id int, src_id int")
    gold = gold_table(spark, [(0, 9)])
    got = {r.tgt_id: (r.src_id, r.origin) for r in A.resolve(4, 11, gold, best, spark).collect()}
    assert got[0] == (9, "gold")
    assert got[1] == (6, "vector")
    assert got[2][1] == got[3][1] == "random"
    assert all(0 <= got[n][0] < 11 for n in (2, 3))
    again = {r.tgt_id: (r.src_id, r.origin) for r in A.resolve(4, 11, gold, best, spark).collect()}
    assert got == again
    counts = {r.origin: r.n_ids for r in A.origin_counts(A.resolve(4, 11, gold, best, spark)).collect()}
    assert counts == {"gold": 1, "vector": 1, "random": 2}


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(l2_normalise(F.col("a")).alias("n"), cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].n == [0.6, 0.8] and got[0].c == pytest.approx(0.96)
    assert got[1].n is None and got[1].c is None


@pytest.mark.parametrize("k", [1, 4])
def test_short_blocks_are_left_out(spark, few_partitions, k):
    rng = np.random.default_rng(7)
    t = rng.normal(size=(60, 5)) * rng.pareto(1.0, (60, 1)) + 0.01
    s = rng.normal(size=(90, 5)) * rng.pareto(0.7, (90, 1))
    s[5] = s[17]  # a tie
    schema = "id int, ord bigint, vector array<double>"
    target, source = (
        spark.createDataFrame([(n, n * 7 % 101, row.tolist()) for n, row in enumerate(side)], schema) for side in (t, s)
    )
    got = A.nearest(target, source, k, block_rows=6).orderBy("tgt_id", "rank").collect()
    scores = np.round(t @ s.T, A.SCORE_DECIMALS)
    for n in range(60):
        best = sorted(range(90), key=lambda j: (-scores[n, j], j * 7 % 101))[:k]
        assert [r.src_id for r in got if r.tgt_id == n] == best
    left, right = A._by_length(target, 6), A._by_length(source, 6)
    lengths = [r._norm for r in right.orderBy("_block", F.desc("_norm")).collect()]
    assert lengths == sorted(lengths, reverse=True)
    found = spark.createDataFrame(
        [(r.tgt_id, r.score) for r in got], "tgt_id int, score double"
    )
    opened = A.open_blocks(left, right, found, k).collect()
    assert len(opened) == 10 and sum(r._blocks for r in opened) < 0.7 * 10 * 15


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000), k=st.integers(1, 4), group=st.sampled_from([6, 12, 24]))
def test_groups_of_blocks_find_the_same(spark, monkeypatch, seed, k, group):
    monkeypatch.setattr(A, "_group_rows", lambda *_: group)
    monkeypatch.setattr(A, "_STEP_ROWS", 5)
    monkeypatch.setattr(A, "_STEP_SOURCES", 7)
    draw = np.random.default_rng(seed)
    sides = [draw.integers(-2, 3, (n, 3)) * draw.integers(1, 4, (n, 1)) + 0.0 for n in (40, 37)]
    target, source = (
        spark.createDataFrame([(n, 100 - n, v.tolist()) for n, v in enumerate(side)], "id int, ord bigint, vector array<double>")
        for side in sides
    )
    got = [(r.tgt_id, r.src_id) for r in A.nearest(target, source, k, block_rows=6).orderBy("tgt_id", "rank").collect()]
    scores = sides[0] @ sides[1].T
    want = [(t, s) for t in range(40) for s in sorted(range(37), key=lambda s: (-scores[t, s], -s))[:k]]
    assert got == want


def test_rows_are_sent_once_per_group(spark):
    rows = spark.range(30_000).select(F.col("id").cast("int"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    groups = -(-30_000 // A._group_rows(rows, rows, 200))
    cores = max(8, spark.sparkContext.defaultParallelism)
    assert groups <= math.ceil(math.sqrt(4 * cores)) + 1
