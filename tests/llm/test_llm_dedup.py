"""Exact dedup and sharding against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vocabbridge.llm import dedup, sharding

LOWER = str.maketrans(dedup.UPPER, dedup.LOWER)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**54 - 1), st.integers(1, 9), max_size=60), st.integers(0, 1023))
def test_filter_keeps_every_entry(entries, top):
    keys = np.array(sorted(entries), np.uint64) | np.uint64(top << 54)
    counts = np.array([entries[k] for k in sorted(entries)], np.int64)
    if len(keys):
        got = dedup.QuotientFilter.from_bytes(dedup.QuotientFilter(keys, counts).to_bytes()).entries()
        assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)
        twice = dedup.merge_entries([got, got])
        assert np.array_equal(twice[0], keys) and np.array_equal(twice[1], 2 * counts)


def test_report(edge_docs):
    rows = edge_docs.collect()
    groups = defaultdict(list)
    for row in rows:
        groups[(row.text or "").translate(LOWER)].append(row.doc_id)
    expected = []
    for row in rows:
        norm = (row.text or "").translate(LOWER)
        ids = groups[norm]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((row.doc_id, keep, len(ids), keep is None or row.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in dedup.duplicate_report(edge_docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_filter_keeps_one_of_each(edge_docs):
    kept = dedup.drop_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted({(r.text or "").translate(LOWER) for r in edge_docs.collect()})


@pytest.mark.parametrize("operator", [dedup.duplicate_report, dedup.drop_duplicates, sharding.assign_shards])
def test_no_documents(make_docs, operator):
    assert operator(make_docs([])).count() == 0


def greedy(sizes, parts):
    """The smallest capacity by trying all sums of neighbours."""
    sums = sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)})
    for capacity in sums:
        used, left = 1, capacity
        for size in sizes:
            if size > capacity:
                used = parts + 1
                break
            if size > left:
                used, left = used + 1, capacity
            left -= size
        if used <= parts:
            return capacity


@pytest.mark.parametrize("knots", [4, 4096])
def test_cuts_have_the_smallest_capacity(spark, monkeypatch, knots):
    monkeypatch.setattr(sharding, "KNOTS", knots)
    draw = np.random.default_rng(knots)
    for n, parts in ((1, 3), (4, 3), (40, 5)):
        sizes = draw.integers(8, 900, n).tolist()
        ends = np.cumsum(sizes).tolist()
        cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], parts)
        assert cuts[-1] == ends[-1] and set(cuts) <= {0, *ends}
        assert max(np.diff([0, *cuts])) == greedy(sizes, parts)


def local_knots(ends, windows, knots):
    """The same as the query, over an array."""
    found, alone = [], []
    for a, b in windows:
        inside = ends[(ends > a) & (ends <= b)]
        piece = (inside - (a + 1)) // max(1, -(-(b - a) // knots))
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        last = np.append(first[1:], len(inside))
        found.append(inside[last - 1])
        alone.append(last - first == 1)
    return np.concatenate(found), np.concatenate(alone)


def filled(ends, capacity):
    """How many parts a greedy fill needs."""
    at, parts = 0, 0
    while at < ends[-1]:
        after = int(ends[np.searchsorted(ends, at + capacity, side="right") - 1])
        if after == at:
            return len(ends) + 1
        at, parts = after, parts + 1
    return parts


@pytest.mark.parametrize("parts", [24, 256, 1024])
def test_many_shards_end(monkeypatch, parts):
    rounds = []
    monkeypatch.setattr(sharding, "_knots", lambda ends, w, k: rounds.append(k) or local_knots(ends, w, k))
    for seed in range(3):
        draw = np.random.default_rng(seed)
        sizes = (8 + draw.pareto(1.5, 15_000) * 200).astype(np.int64).clip(8, 10**6)
        ends = np.cumsum(sizes)
        rounds.clear()
        cuts = sharding.minimax_cuts(ends, int(ends[-1]), parts)
        capacity = int(max(np.diff([0, *cuts])))
        assert len(cuts) == parts and np.isin(cuts, [0, *ends]).all()
        assert filled(ends, capacity) <= parts < filled(ends, capacity - 1)
        assert len(rounds) < 30 and max(rounds) <= 2 * sharding.KNOTS + 8 * parts**2


def test_shards(edge_docs, make_docs, words):
    docs = edge_docs.unionByName(make_docs([" ".join(words[i : i + 9]) for i in range(300)], range(100, 400)))
    rows = sharding.assign_shards(docs, 5).collect()
    assert len(rows) == docs.count()
    by_text = defaultdict(set)
    texts = {}
    for row in docs.collect():
        texts.setdefault(row.doc_id, (row.text or "").encode())
    for row in rows:
        if row.doc_id is not None:
            body = texts[row.doc_id]
            assert (row.size, row.text_crc32) == (len(body) + 8, zlib.crc32(body))
            by_text[body].add(row.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    # Two texts are far larger than a fair share; the others share the rest evenly.
    loads = sorted(sum(r.size for r in rows if r.shard == s) for s in range(5))
    assert loads[2] - loads[0] < 20_010


def test_one_text_may_be_a_third(make_docs, words):
    docs = make_docs(["hot text"] * 500 + [" ".join(words[i : i + 3]) for i in range(300)])
    rows = sharding.assign_shards(docs, 4).collect()
    assert len({r.shard for r in rows if r.doc_id < 500}) == 1
    assert len({r.shard for r in rows}) == 4
