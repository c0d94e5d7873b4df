"""Mixing: targets, closeness, bounds, repeatability."""

from collections import defaultdict

import numpy as np
import pytest

from vocabbridge.llm import mixing


def brute_targets(sizes):
    """Share by weight, cut at three times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        shares = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if shares[s] > 3 * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 100, None: 7}, {"x": 5}, {"a": 0, "b": 9}, {"a": 1, "é": 1, "z": 1000, "q": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for source, target in want.items():
        assert got[source] == pytest.approx(target)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(n):
    one, two = (mixing.permuted(np.arange(n), n, np.full(n, key)) for key in (1, 2))
    assert sorted(one) == sorted(two) == list(range(n))
    if n > 20:
        assert (one != two).any() and (one != np.arange(n)).any()


def test_mix(make_docs, words):
    docs = make_docs([" ".join(words[i % 300 : i % 300 + 60]) for i in range(900)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 900
    taken, target = defaultdict(int), {}
    for row in rows:
        assert 0 <= row.taken <= 3 * row["size"]
        taken[row.source] += row.taken
        target[row.source] = row.target
    for source, wanted in target.items():
        assert taken[source] == pytest.approx(wanted, rel=0.03)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


@pytest.mark.parametrize("small", [[10, 70, 100], [1, 2, 200], [64, 65, 130]])
def test_small_sources_come_near_their_target(spark, words, small):
    rows = [(1000 + i, "s%d" % n, " ".join(words[:n])) for i, n in enumerate(small)]
    rows += [(i, "big", " ".join(words[i % 200 : i % 200 + 120])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, target = defaultdict(int), {}
    for row in mixing.mix(docs).collect():
        assert row.taken <= 3 * row["size"]
        taken[row.source] += row.taken
        target[row.source] = row.target
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= max(1.0, 0.02 * wanted), (source, taken[source], wanted)


def test_edges(edge_docs, make_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    repeated = mixing.repeat_documents(edge_docs)
    assert repeated.columns == edge_docs.columns
    repeated.count()
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([None, ""])).collect()[0].taken == 0
    assert mixing.repeat_documents(make_docs([])).count() == 0
