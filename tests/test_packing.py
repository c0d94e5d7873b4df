import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocabbridge.operators import buffers as B
from vocabbridge.operators import packing as P
from vocabbridge.streaming import feed as S

FEW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def tokens(spark, lengths, split="train"):
    rows, n = [], 0
    for place, length in enumerate(lengths):
        rows.append((split, place, list(range(n, n + length))))
        n += length
    return spark.createDataFrame(rows, "split string, split_idx bigint, input_ids array<int>")


def blocks_of(df):
    return [r.input_ids for r in df.orderBy("split", "shard", "batch", "block").collect()]


@pytest.mark.parametrize(
    ("total", "train", "validation"), [(8, [4, 4], [4, 4]), (10, [4, 4], [4, 4]), (3, [], [3])]
)
def test_block_edges(spark, total, train, validation):
    for split, sizes in (("train", train), ("validation", validation)):
        got = blocks_of(P.pack(tokens(spark, [1] * total, split), 4))
        assert [len(b) for b in got] == sizes


@FEW
@given(
    lengths=st.lists(st.integers(0, 11), min_size=1, max_size=25),
    block=st.integers(1, 7),
    batch=st.integers(1, 6),
    shards=st.integers(1, 4),
)
def test_packing_matches_plain_lists(spark, lengths, block, batch, shards):
    df = tokens(spark, lengths, "validation")
    rows = [r.input_ids for r in df.orderBy("split_idx").collect()]
    expected = []
    at = 0
    for shard in range(shards):
        size = len(rows) // shards + (shard < len(rows) % shards)
        part, at = rows[at : at + size], at + size
        for begin in range(0, len(part), batch):
            ids = [i for row in part[begin : begin + batch] for i in row]
            keep = len(ids) // block * block if len(ids) >= block else len(ids)
            expected += [ids[k : k + block] for k in range(0, keep, block)]
    packed = P.pack(df, block, batch, shards)
    assert blocks_of(packed) == expected
    assert packed.where(F.size("input_ids") != F.size("attention_mask")).count() == 0


def test_block_length():
    assert P.block_length(None, 2048) == 1024
    assert P.block_length(None, 512) == 512
    assert P.block_length(4096, 2048) == 2048
    assert P.block_length(128, 2048) == 128


def test_buffers_close_with_the_row_that_fills_them(spark):
    df = spark.createDataFrame(list(enumerate([4, 4, 4, 10, 1])), "row_idx bigint, n bigint")
    got = P.assign_buffers(df, "n", 10).orderBy("row_idx").collect()
    assert [r.buffer for r in got] == [0, 0, 0, 3, 4]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lengths=st.lists(st.one_of(st.integers(0, 9), st.sampled_from([40, 200])), min_size=1, max_size=80),
    limit=st.sampled_from([1, 3, 7.5, 12, 30]),
    span=st.integers(1, 5),
)
def test_buffers_match_a_sequential_walk(spark, lengths, limit, span):
    df = spark.createDataFrame(list(enumerate(lengths)), "row_idx bigint, n bigint")
    got = P.assign_buffers(df, "n", limit, span, fan=3).orderBy("row_idx").collect()
    assert [r.buffer for r in got] == walk(lengths, limit)


def walk(lengths, limit):
    """The first row of each row's buffer, one row after the other."""
    out, start, filled = [], 0, 0
    for n, length in enumerate(lengths):
        if filled >= limit:
            start, filled = n, 0
        out.append(start)
        filled += length
    return out


def test_buffers_over_three_levels(spark, few_partitions):
    draw = random.Random(4)
    lengths = [draw.choice([0, 1, 2, 5, 30]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(lengths)), "row_idx bigint, n bigint")
    scan = B.Buffers(df, "n", 7, span=3, fan=8)
    assert len(scan.levels) == 4 and scan.total == sum(lengths)
    got = scan.numbered([(0, 0)]).orderBy("row_idx").collect()
    assert [r.buffer for r in got] == walk(lengths, 7)
    assert len(scan.whole().upto) <= 8


def test_no_rows_give_no_buffers(spark):
    none = spark.createDataFrame([], "row_idx bigint, n bigint")
    assert P.assign_buffers(none, "n", 5).count() == 0
    placed, _ = P.repeated_buffers(none, "n", 5, 2)
    assert placed.count() == 0


def steps_of(draw, low):
    n = draw.randint(1, 4)
    upto = sorted(draw.sample(range(low, low + 12), n))
    return B.Steps(*(np.array(v) for v in (upto, [draw.randint(low + 12, low + 20) for _ in upto], range(low, low + n))))


def test_composition_is_associative():
    draw = random.Random(2)
    for _ in range(200):
        a, b, c = (steps_of(draw, low) for low in (0, 10, 20))
        for left, right in ((a.then(b).then(c), a.then(b.then(c))),):
            for enter in range(33):
                if enter <= a.upto[-1]:
                    assert left.step(enter) == right.step(enter)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lengths=st.lists(st.one_of(st.integers(0, 9), st.just(40)), min_size=1, max_size=12),
    limit=st.sampled_from([1, 3, 7.5, 12, 30, 200]),
    epochs=st.integers(1, 6),
)
def test_repeated_buffers_match_a_sequential_walk(spark, few_partitions, lengths, limit, epochs):
    n = len(lengths)
    expected = {}
    for seq, start in enumerate(walk(lengths * epochs, limit)):
        expected.setdefault((start // n, start % n), []).append((seq % n, seq - start // n * n))
    df = spark.createDataFrame(list(enumerate(lengths)), "row_idx bigint, n bigint")
    placed, table = P.repeated_buffers(df, "n", limit, epochs, span=2)
    got = {}
    for r in placed.join(table, "class").orderBy("place").collect():
        got.setdefault((r.epoch, r.buffer), []).append((r.row_idx, r.place))
    assert got == expected


def test_epochs_run_into_a_cycle(spark):
    lengths = [3, 4, 5]
    df = spark.createDataFrame(list(enumerate(lengths)), "row_idx bigint, n bigint")
    scan = B.Buffers(df, "n", 5)
    cycle = B.Epochs(scan.whole(), scan.total)
    starts = walk(lengths * 40, 5)
    for epoch in range(40):
        first = next((s for s in starts if s // 3 == epoch), None)
        begins = [0, 3, 7]
        assert first == epoch * 3 + next(i for i, b in enumerate(begins) if b >= cycle.enter(epoch))
    placed, table = P.repeated_buffers(df, "n", 5, 40)
    assert table.count() == 40
    assert table.select("class").distinct().count() <= len(cycle.enters) + 1 <= 4


def test_buffered_feed_drops_tails_and_shuffles_inside(spark):
    df = spark.createDataFrame(
        [(n, 5, list(range(10 * n, 10 * n + 5))) for n in range(9)],
        "row_idx bigint, n_chars bigint, input_ids array<int>",
    )
    plain = S.buffered_feed(df, 4, 15, shuffle=False)
    mixed = S.buffered_feed(df, 4, 15, shuffle=True, seed=3)
    assert plain.count() == 9
    key = lambda rows: sorted((r.buffer, r.block, tuple(r.input_ids)) for r in rows.collect())
    assert key(plain) == key(mixed)
    for group in mixed.groupBy("buffer").agg(F.sort_array(F.collect_list("place")).alias("p")).collect():
        assert group.p == list(range(len(group.p)))
    ended = S.buffered_feed(df, 6, 15, eos=99, shuffle=False).orderBy("buffer", "block").collect()
    assert ended[0].input_ids == [0, 1, 2, 3, 4, 99]


def test_packed_feed_checks_lengths(spark):
    good = spark.createDataFrame([(0, [1, 2])], "row_idx bigint, input_ids array<int>")
    row = S.packed_feed(good, 2).first()
    assert row.labels == row.input_ids == [1, 2]
    assert S.packed_feed(good, 2).schema["labels"].dataType.simpleString() == "array<bigint>"
    with pytest.raises(Exception, match="expected 3 token ids"):
        S.packed_feed(good, 3).collect()
    assert S.wrong_lengths(good, 3).count() == 1


def test_feed_chooses_its_way(spark):
    packed = spark.createDataFrame([(n, [n, n]) for n in range(5)], "row_idx bigint, input_ids array<int>")
    turned = S.feed(packed, 2, 10, start=2, epochs=2).orderBy("epoch", "row_idx").collect()
    assert [r.input_ids[0] for r in turned] == [2, 3, 4, 0, 1] * 2
    shard = S.feed(packed, 2, 10, worker=1, workers=2).collect()
    assert {r.input_ids[0] for r in shard} == {1, 3}
    raw = packed.withColumn("n_chars", F.lit(2).cast("bigint"))
    assert S.feed(raw, 3, 4, shuffle=False).count() == 2
