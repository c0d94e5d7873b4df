"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one of good text, from labelled
documents, and one of the raw corpus, from all documents.  The n-grams are two and four
bytes, and triples of words of which only their lengths and which of them are equal is
looked at.  A document's weight is the ratio of the two likelihoods of
``EFFECTIVE_GRAMS`` n-grams: the mean over its own, the three kinds alike, so that
length by itself neither helps nor harms.  Documents are drawn without replacement in
proportion to their weights: each log weight gets a Gumbel variable, hashed from the id,
and the k largest sums are taken.  k is the expected number of good documents: a
logistic curve from the mean log ratio to the labels, summed up over all documents.

The good model and the curve are fitted on about ``SAMPLE_LABELS`` labelled rows, chosen
by a hash of their id; everything else is counted over all documents.

Nulls and edges: a null or empty text has log weight 0.  Labels without ``doc_id`` or
``quality`` are not used; without good labels all documents are kept.  Ties go to the
smaller ``doc_id``, null first; rows equal in all of that are kept or dropped together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import Slice, frugal, slices, word_hashes, words
from vocabbridge.llm.ordered import running
from vocabbridge.storage import stored

SAMPLE_LABELS = 20_000
BUCKETS = 1 << 16
# Pseudo counts that the good model takes from the raw one.
SMOOTHING = 65_536.0
EFFECTIVE_GRAMS = 256
ORDERS = 3
SCALE = 1 << 20
SEED = 5


def grams(part: Slice) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of n-gram: the bucket at each place, and the first place and the end of each text."""
    data = part.data.astype(np.uint32)
    out = []
    for order in (2, 4):
        packed = np.zeros(max(0, len(data) - order + 1), np.uint32)
        for k in range(order):
            packed |= data[k : len(data) - order + 1 + k] << np.uint32(8 * k)
        if order > 2:
            packed = (packed * np.uint32(2654435761)) >> np.uint32(16)
        begin = np.minimum(part.offsets[:-1], len(packed))
        out.append((packed, begin, begin + np.maximum(np.diff(part.offsets) - order + 1, 0)))
    found = words(part)
    hashes, length = word_hashes(found), np.minimum(np.diff(found.borders), 15)
    bucket = np.zeros(max(0, len(hashes) - 2), np.int64)
    if len(bucket):
        one, two, three = hashes[:-2], hashes[1:-1], hashes[2:]
        bucket = (one == two) * 4 + (two == three) * 2 + (one == three) + 8 * (length[1:-1] * 16 + length[2:])
    begin = np.minimum(found.by_text[:-1], len(bucket))
    out.append((bucket, begin, begin + np.maximum(np.diff(found.by_text) - 2, 0)))
    return out


def gram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often each n-gram occurs in all texts: ``BUCKETS`` numbers for each kind."""

    def run(batches):
        total = np.zeros((ORDERS, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for counts, (bucket, begin, end) in zip(total, grams(part), strict=True):
                    edges = np.zeros(len(bucket) + 1, np.int64)
                    np.add.at(edges, begin, 1)
                    np.subtract.at(edges, end, 1)
                    counts += np.bincount(bucket[np.cumsum(edges[:-1]) > 0], minlength=BUCKETS)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["gram", "n"])

    counted = docs.select(text).mapInArrow(frugal(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    out = np.zeros(ORDERS * BUCKETS)
    out[rows["gram"]] = rows["n"]
    return out.reshape(ORDERS, BUCKETS)


def log_ratios(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the good over the raw probability of each n-gram, in units of 1 / ``SCALE``."""
    raw_total = np.maximum(raw.sum(axis=1, keepdims=True), 1)
    raw_share = (raw + 0.5) / (raw_total + 0.5 * BUCKETS)
    good_share = (good + SMOOTHING * raw_share) / (good.sum(axis=1, keepdims=True) + SMOOTHING)
    return np.round(np.log(good_share / raw_share) * SCALE).astype(np.int64)


def weigh(docs: DataFrame, ratios: np.ndarray, text: str) -> DataFrame:
    """``docs`` with ``__weight``, its log, and ``__grams``, the number of n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(place)):
                weight = np.zeros(part.last - part.first)
                count = np.zeros(part.last - part.first, np.int64)
                for ratio, (bucket, begin, end) in zip(shared.value, grams(part), strict=True):
                    # Sums of whole numbers, so that a text's place in a slice does not matter.
                    sums = np.concatenate([[0], np.cumsum(ratio[bucket])])
                    weight += (sums[end] - sums[begin]) / (np.maximum(end - begin, 1) * (SCALE * ORDERS))
                    count += end - begin
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.first, part.last - part.first).columns,
                        pa.array(EFFECTIVE_GRAMS * weight),
                        pa.array(count),
                    ],
                    names=[*batch.schema.names, "__weight", "__grams"],
                )

    typed = docs.withColumn("__weight", F.lit(None).cast("double")).withColumn("__grams", F.lit(None).cast("long"))
    return docs.mapInArrow(frugal(run), typed.schema)


def fit_curve(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps with a weak prior."""
    x = np.stack([scores, np.ones_like(scores)])
    theta = np.zeros(2)
    prior = np.diag([1e-4, 1e-4])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (good - chance) - prior @ theta
        hessian = (x * (chance * (1 - chance))) @ x.T + prior
        step = np.linalg.solve(hessian, gradient)
        theta = theta + step / max(1.0, float(np.abs(step).max()) / 10)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def gumbel(doc_id: Column) -> Column:
    """A standard Gumbel variable hashed from the id."""
    unit = (F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def mean_ratio() -> Column:
    return F.col("__weight") / EFFECTIVE_GRAMS


class Model:
    """The fitted ratios and curve; ``threshold`` draws the sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.doc_id, self.text = doc_id, text
        known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        known = known.select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("int").alias("_good"))
        n = max(1, known.count())
        luck = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 32)) / float(1 << 32)
        # About SAMPLE_LABELS rows, so small enough for every worker.
        sample = F.broadcast(known.where(luck < SAMPLE_LABELS / n).dropDuplicates(["_id"]))
        labelled = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(sample, "_id")
        good = gram_counts(labelled.where("_good = 1"), "text")
        self.ratios = log_ratios(good, gram_counts(docs, text)) if good.sum() else None
        if self.ratios is None:
            return
        scored = weigh(labelled.select("_good", "text"), self.ratios, "text").select("_good", mean_ratio().alias("x"))
        rows = scored.toPandas()
        self.slope, self.offset = fit_curve(rows["x"].to_numpy(), rows["_good"].to_numpy(float))

    def scores(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``__weight, __grams, __key``; the largest keys are drawn."""
        return weigh(docs, self.ratios, self.text).withColumn("__key", F.col("__weight") + gumbel(F.col(self.doc_id)))

    def drawn(self, scores: DataFrame) -> Column:
        """Whether a row of a stored table of scores is among the k drawn."""
        chance = 1 / (1 + F.exp(-(F.lit(self.slope) * mean_ratio() + F.lit(self.offset))))
        k = scores.agg(F.sum(chance)).first()[0]
        k = int(round(k or 0))
        ranked = running(
            scores.select((-F.col("__key")).alias("low"), F.col(self.doc_id).alias("id"), F.lit(1).alias("one")),
            ["low", "id"], {"rank": "one"},
        )
        last = ranked.where(F.col("rank") == k - 1).select("low", "id").first()
        if last is None:
            return F.lit(k > 0)
        key, id_ = F.lit(-last["low"]), F.col(self.doc_id)
        tie = id_.isNull() if last["id"] is None else id_.isNull() | (id_ <= last["id"])
        return (F.col("__key") > key) | ((F.col("__key") == key) & tie)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, log_weight, n_grams, key, kept``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = Model(docs, labels)
    if model.ratios is None:
        zero = F.lit(0.0)
        return docs.select(
            "doc_id", zero.alias("log_weight"), F.lit(0).cast("long").alias("n_grams"), zero.alias("key"), F.lit(True).alias("kept")
        )
    scores = stored(model.scores(docs).drop("text"), "scores")
    return scores.select(
        "doc_id", F.col("__weight").alias("log_weight"), F.col("__grams").alias("n_grams"), F.col("__key").alias("key"),
        model.drawn(scores).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not drawn."""
    model = Model(docs, labels, doc_id, text)
    if model.ratios is None:
        return docs
    scores = stored(model.scores(docs), "scores")
    return scores.where(model.drawn(scores)).select(*docs.columns)
