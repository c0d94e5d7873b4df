"""Language identification and the quality classifier: held-out accuracy and edges."""

import random

import numpy as np
import pytest

from vocabbridge.llm import langid, quality

FOLDER = "/root/testdata/sf0.001"


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    network = langid.ByteNetwork(3)
    for i, p in enumerate(network.parameters()):
        network.parameters()[i][...] = p.astype(np.float32)
    letters = draw.integers(1, 255, (6, langid.WINDOW + max(langid.WIDTHS) - 1)).astype(np.uint8)
    labels = np.array([0, 1, 2, 0, 1, 2])
    loss, gradient = network.gradients(letters, labels)
    for p, g in zip(network.parameters(), gradient, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        above = network.gradients(letters, labels)[0]
        p[at] = old - step
        below = network.gradients(letters, labels)[0]
        p[at] = old
        assert (above - below) / (2 * step) == pytest.approx(g[at], rel=0.2, abs=1e-3)


def test_tables_are_the_filters():
    network = langid.ByteNetwork(2)
    letters = np.random.default_rng(1).integers(0, 255, (4, langid.WINDOW + max(langid.WIDTHS) - 1)).astype(np.uint8)
    pooled = [
        sum((network.embedding @ w[k])[letters[:, k : k + langid.WINDOW]] for k in range(width)).max(axis=1)
        for width, w in zip(langid.WIDTHS, network.filters, strict=True)
    ]
    hidden = np.maximum(np.concatenate(pooled, 1) + network.bias, 0)
    plain = langid.softmax(hidden @ network.out + network.out_bias)
    assert network.predict(network.tables(), letters) == pytest.approx(plain, abs=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_language_edges(spark, edge_docs, make_docs):
    rows = langid.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for row in rows:
        if row.doc_id in (0, 1, 2):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        assert row.lang_pred in ("en", "fr", "und") and 0 <= row.score <= 1
    assert langid.identify(make_docs([])).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def brute_weight(text, ratios):
    """Mean log ratio by a loop over n-grams."""
    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    sums = []
    for kind, order in ((0, 2), (1, 4)):
        grams = [int.from_bytes(raw[i : i + order], "little") for i in range(len(raw) - order + 1)]
        buckets = [g if order == 2 else ((g * 2654435761) % (1 << 32)) >> 16 for g in grams]
        sums.append([ratios[kind][b] for b in buckets])
    found = lower.split()
    triples = zip(found, found[1:], found[2:], strict=False)
    sums.append([
        ratios[2][(a == b) * 4 + (b == c) * 2 + (a == c) + 8 * (min(len(b), 15) * 16 + min(len(c), 15))] for a, b, c in triples
    ])
    return quality.EFFECTIVE_GRAMS * sum(sum(s) / max(len(s), 1) for s in sums) / (quality.SCALE * quality.ORDERS)


@pytest.fixture(scope="module")
def graded(spark, words):
    """Good prose, and junk of repeated words, half of each labelled."""
    draw = random.Random(8)
    good = [" ".join(draw.choice(words) for _ in range(draw.randint(8, 90))) + "." for _ in range(220)]
    junk = [" ".join([draw.choice(words).upper() + "!!"] * draw.randint(8, 90)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = [(i, int(i < 220), 0) for i in range(0, 260, 2)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_good_stays(graded):
    docs, labels = graded
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 260
    assert sum(r.kept for r in rows if r.doc_id < 220) >= 218
    assert sum(r.kept for r in rows if r.doc_id >= 220) <= 2
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept


def test_weights(graded):
    docs, labels = graded
    model = quality.Model(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in model.scores(docs).where("doc_id % 20 = 0").collect():
        assert row["__weight"] == pytest.approx(brute_weight(texts[row.doc_id], model.ratios), abs=1e-6)


def test_quality_edges(spark, edge_docs, make_docs, graded):
    docs = edge_docs.unionByName(make_docs([r.text for r in graded[0].collect()], range(100, 360)))
    labels = graded[1].selectExpr("doc_id + 100 AS doc_id", "quality", "toxic")
    labels = labels.unionAll(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))
    assert quality.judge(docs, labels).count() == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.judge(make_docs([]), labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == docs.count()
