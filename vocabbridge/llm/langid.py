"""Language identification with a convolutional network over bytes.

Bytes are embedded; filters of several widths slide over fixed-length windows; the
largest value of each filter in the window goes, rectified, to a softmax layer.  The
network is trained in numpy on a bounded sample of labelled texts.  It is applied to all
windows of whole texts in batches; a text's probabilities are the mean of its windows',
by their bytes.

Applied, a filter is a sum of rows of byte-pair tables, so a window costs two lookups a
byte.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0, and so
is everything if no labelled text can be learned from.  Rows without ``lang`` are not
learned from.  A null ``doc_id`` is not held out.  Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import Slice, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# The training sample: about so many documents per language, so many windows of each,
# and as many shortened windows.
TRAIN_DOCS = 240
TRAIN_WINDOWS = 4
EPOCHS = 5
BATCH = 64
RATE = 0.01
SEED = 7
# Windows that are worked on together.
TOGETHER = 256
UNDETERMINED = "und"


def window_places(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text of all windows of a slice, in order."""
    sizes = np.diff(part.offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = part.offsets[:-1][text] + number * WINDOW
    return begin, np.minimum(WINDOW, part.offsets[1:][text] - begin), text


def cut(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The windows' bytes, with zeros up to the widest filter's reach."""
    place = np.arange(WINDOW + max(WIDTHS) - 1)
    at = np.minimum(begin[:, None] + place, len(data) - 1)
    return np.where(place < lengths[:, None], data[at], 0).astype(np.uint8)


class ByteNetwork:
    """Embedding, filters, softmax."""

    def __init__(self, classes: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.embedding = draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [
            draw.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS
        ]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    @classmethod
    def of(cls, parameters: list[np.ndarray]) -> ByteNetwork:
        self = object.__new__(cls)
        self.embedding, *self.filters, self.bias, self.out, self.out_bias = parameters
        return self

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def gradients(self, letters: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of labelled windows and its gradient by each parameter."""
        n = len(letters)
        pooled, places = [], []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            values = sum((self.embedding @ weights[k])[letters[:, k : k + WINDOW]] for k in range(width))
            places.append(values.argmax(axis=1))
            pooled.append(values.max(axis=1))
        raw = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        chance = softmax(hidden @ self.out + self.out_bias)
        loss = float(-np.log(chance[np.arange(n), labels] + 1e-9).mean())
        chance[np.arange(n), labels] -= 1
        chance /= n
        back = (chance @ self.out.T) * (raw > 0)
        by_embedding = np.zeros_like(self.embedding)
        by_filters = []
        rows = np.repeat(np.arange(n), FILTERS)
        columns = np.tile(np.arange(FILTERS), n)
        for i, (width, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            flow = back[:, i * FILTERS : (i + 1) * FILTERS].ravel()
            by_weights = np.zeros_like(weights)
            for k in range(width):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (letters[rows, places[i].ravel() + k], columns), flow)
                by_weights[k] = self.embedding.T @ table
                by_embedding += table @ weights[k].T
            by_filters.append(by_weights)
        by_embedding[0] = 0
        return loss, [by_embedding, *by_filters, back.sum(0), hidden.T @ chance, chance.sum(0)]

    def fit(self, letters: np.ndarray, labels: np.ndarray) -> ByteNetwork:
        """Adam over shuffled batches."""
        draw = np.random.default_rng(SEED)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(letters))
            for begin in range(0, len(order), BATCH):
                chosen = order[begin : begin + BATCH]
                _, gradient = self.gradients(letters[chosen], labels[chosen])
                step += 1
                for p, g, m, v in zip(self.parameters(), gradient, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a byte pair adds to the filters that begin at it, and two bytes before it."""
        here, later = [], []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            parts = [self.embedding @ weights[k] for k in range(width)]
            zero = np.zeros_like(parts[0])
            parts += [zero] * (4 - width)
            here.append((parts[0][:, None] + parts[1][None]).reshape(65536, FILTERS))
            later.append((parts[2][:, None] + parts[3][None]).reshape(65536, FILTERS))
        return np.concatenate(here, 1), np.concatenate(later[1:], 1)

    def predict(self, tables, letters: np.ndarray) -> np.ndarray:
        """Class probabilities of windows."""
        pair = letters[:, :-1].astype(np.int32) << 8 | letters[:, 1:]
        values = tables[0][pair[:, :WINDOW]]
        values[:, :, FILTERS:] += tables[1][pair[:, 2 : WINDOW + 2]]
        hidden = np.maximum(values.max(axis=1) + self.bias, 0)
        return softmax(hidden @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept back for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame) -> DataFrame:
    """``lang, doc_id, number, letters`` of a sample of labelled ``doc_id, text, lang`` rows.

    About ``TRAIN_DOCS`` documents of each language, chosen by a hash of the id.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    luck = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    sample = labelled.join(F.broadcast(sizes), "lang").where(luck < TRAIN_DOCS / F.col("n"))

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                begin, length, text = window_places(part)
                for row in range(part.last - part.first):
                    own = np.flatnonzero(text == row)
                    own = own[np.unique(np.linspace(0, len(own) - 1, TRAIN_WINDOWS).astype(int))] if len(own) else own
                    pieces = [part.data[begin[i] : begin[i] + length[i]].tobytes() for i in own]
                    n, at = len(pieces), part.first + row
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("lang")[at].as_py()] * n, pa.string()),
                            pa.array([batch.column("doc_id")[at].as_py()] * n, pa.int64()),
                            pa.array(range(n), pa.int32()),
                            pa.array(pieces, pa.binary()),
                        ],
                        names=["lang", "doc_id", "number", "letters"],
                    )

    return sample.select("doc_id", "text", "lang").mapInArrow(
        run, "lang string, doc_id long, number int, letters binary"
    )


def train(docs: DataFrame) -> tuple[list[str], ByteNetwork | None]:
    """Labels and network, from rows ``doc_id, text, lang``."""
    rows = training_windows(docs).toPandas().sort_values(["lang", "doc_id", "number", "letters"])
    labels = sorted(rows["lang"].unique(), key=lambda x: x.encode())
    if not labels:
        return [], None
    pieces = [np.frombuffer(x, np.uint8) for x in rows["letters"]]
    draw = np.random.default_rng(SEED)
    pieces += [p[: draw.integers(min(8, len(p)), len(p) + 1)] for p in pieces]  # short texts exist, too
    data = np.concatenate([*pieces, [np.uint8(0)]]).astype(np.uint8)
    lengths = np.array([len(p) for p in pieces])
    letters = cut(data, np.cumsum(lengths) - lengths, lengths)
    target = np.tile([labels.index(x) for x in rows["lang"]], 2)
    return labels, ByteNetwork(len(labels)).fit(letters, target)


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labels, network = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((labels, network.parameters() if network else None))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        labels, parameters = shared.value
        network = ByteNetwork.of(parameters) if parameters else None
        tables = network.tables() if network else None
        for batch in batches:
            n = batch.num_rows
            chance = np.zeros((n, max(1, len(labels))))
            for part in slices(batch.column("text")) if network else ():
                begin, length, owner = window_places(part)
                for at in range(0, len(begin), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    found = network.predict(tables, cut(part.data, begin[some], length[some]))
                    np.add.at(chance, part.first + owner[some], found * length[some, None])
            total = chance.sum(axis=1)
            known = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool) & (total > 0)
            best = chance.argmax(axis=1)
            score = np.where(known, np.minimum(1.0, chance.max(axis=1) / np.maximum(total, 1e-9)), 0.0)
            names = [labels[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    columns = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("letters"), "text")
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
