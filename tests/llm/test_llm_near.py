"""ProbMinHash near duplicates against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vocabbridge.llm import blocks, near
from vocabbridge.llm.graph import components


def shingle_counts(text):
    found = bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()).split()
    if len(found) < 5:
        return Counter([tuple(found)] if found else [])
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_similarity(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[z] / a[e], b[z] / b[e]) for z in every) for e in a.keys() & b.keys())


def brute_classes(rows):
    """Smallest id of the component of every row number."""
    label = list(range(len(rows)))
    sets = [shingle_counts(t) for _, t in rows]
    texts = [(t or "").encode().lower().split() for _, t in rows]  # bytes: only A-Z are lower-cased

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or texts[i] == texts[j] or (sets[i] and sets[j] and brute_similarity(sets[i], sets[j]) >= 0.8):
                label[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    smallest = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return [(rows[i][0], smallest[find(i)], len(groups[find(i)])) for i in range(len(rows))]


@pytest.fixture(scope="module")
def family(words):
    """Chains of copies with a few words changed, a shared passage, and unrelated texts."""
    draw = random.Random(6)
    texts = []
    for _ in range(8):
        base = [draw.choice(words) for _ in range(120)]
        for _ in range(6):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(draw.randint(0, 2)):
                base[draw.randrange(len(base))] = draw.choice(words)
    passage = [draw.choice(words) for _ in range(40)]
    texts += [" ".join([draw.choice(words) for _ in range(60)] + passage) for _ in range(30)]
    texts += [" ".join(["again and again we say"] * n) for n in (3, 4, 12, 13)]
    return texts


def test_classes(make_docs, family, monkeypatch):
    docs = make_docs(family)
    got = [(r.doc_id, r.class_id, r.class_size) for r in near.near_classes(docs).collect()]
    assert sorted(got) == sorted(brute_classes(list(enumerate(family))))
    monkeypatch.setattr(near, "BLOCK", 2)  # many blocks to a bucket
    small = [(r.doc_id, r.class_id, r.class_size) for r in near.near_classes(docs).collect()]
    assert sorted(small) == sorted(got)


def test_links_left_in_blocks(spark, monkeypatch):
    """Buckets that pivots have not joined are tested across their blocks."""
    monkeypatch.setattr(near, "BLOCK", 2)
    sets = [set(range(c * 100, c * 100 + 20)) - {c * 100 + i} for c in range(2) for i in range(5)]
    rows = [(i, np.array(sorted(s), np.uint32).tobytes(), b"") for i, s in enumerate(sets)]
    members = spark.createDataFrame([(7, i, i) for i in range(10)], "key long, node long, comp long")
    df = spark.createDataFrame(rows, "node long, items binary, weights binary")
    links = near._left_links(members, df)
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {i: i // 5 * 5 for i in range(10)}


def test_similarity(family):
    sets = [shingle_counts(t) for t in family]
    parts = next(iter(blocks.slices(pa.array(family))))
    owner, element, weight, _, _ = near.shingles(parts)
    for i, j in ((0, 1), (0, 5), (3, 40), (78, 79), (80, 81), (78, 81)):
        sides = []
        for k in (i, j):
            own = owner == k
            items = (element[own] >> np.uint64(12)).astype(np.uint32)
            sides += [items.tobytes(), weight[own].astype(np.uint32).tobytes()]
        assert near.similarity(*sides) == pytest.approx(brute_similarity(sets[i], sets[j]))


def test_registers_estimate_similarity(family, monkeypatch):
    monkeypatch.setattr(near, "BANDS", 200)
    parts = next(iter(blocks.slices(pa.array(family))))
    owner, element, weight, _, _ = near.shingles(parts)
    winner = near.registers(owner, element, weight, len(family))
    sets = [shingle_counts(t) for t in family]
    for i, j in ((0, 1), (0, 5), (78, 79), (80, 81), (79, 80)):
        agree = (winner[i] == winner[j]).mean()
        assert agree == pytest.approx(brute_similarity(sets[i], sets[j]), abs=0.07)


def test_edges(edge_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = [(r.doc_id, r.class_id, r.class_size) for r in near.near_classes(edge_docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_classes(rows)))
    kept = near.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    named = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert set(named) == {c for d, c, _ in got if d == c}
    assert near.near_classes(make_docs([])).count() == 0
    assert near.drop_near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 200), (200, 150)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(41) if i != 40} | {100: 100, 150: 100, 200: 100}
