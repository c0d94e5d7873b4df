"""Order-preserving packing of token ids into windows, by dynamic programming.

Documents follow each other as they are read, each with an end id.  The stream is cut into
windows.  A window costs its padding up to ``max_tokens`` (none if its length is a power
of two), a fixed part, and what its end cuts: nothing at the end of a document, little at
the end of a sentence, more inside one.  Windows hold half of ``max_tokens`` at least, so
with f the least cost up to a place, h(i) = f(i) + i and M the most tokens,

    h(j) = cut(j) + window + M + min(h(j - M/2) - M/2, min of h(i) for j - M <= i <= j - M/2)

The inner minimum slides.  Its monotone queue is held in the two-stack form: the suffix
minima of the older half of the places and the running minima of the newer half, so the
transitions of M/2 places are a few array operations.

A task solves one stretch (a slice of some MB of text) at a time.  The last window end
near the end of a stretch that costs least is kept, and what follows it opens the next
stretch.  What is left at the end of a partition is one padded window or windows of
powers of two, whichever costs less.  No text is shuffled, no task holds more than a
stretch, and a task that is run again gives the same rows.

Nulls and edges: a null text is an empty one, which still has its end id.  A null
``doc_id`` is kept.  Repeated rows are documents of their own.  A document longer than a
window is cut.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import ranges, slices
from vocabbridge.llm.bpe import LEXICON_BYTES, Encoder, Merges, char_classes

MAX_TOKENS = 1024
END_ID = 0
# Costs in tokens of padding: a window, a cut after a sentence, a cut inside one.
WINDOW, AFTER_SENTENCE, INSIDE = 4, 2, 8
# Bytes of text per stretch, and words whose ids a worker keeps.
STRETCH_BYTES = 3 << 20
KEPT_WORDS = 300_000

_FAR = np.int64(1) << 61
_LOW = (np.int64(1) << 32) - 1


def window_ends(cuts: np.ndarray, most: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost up to each place, and where the window that ends there begins.

    ``cuts``: the cost of a cut at places 0 to n; ``most``: a power of two.  Places that
    no sequence of windows reaches cost ``_FAR >> 33`` or more.
    """
    half, n = most // 2, len(cuts) - 1
    size = (n // half + 1) * half
    # h and its place in one number, so that a minimum keeps its place; half a window of none first.
    best = np.full(half + size, _FAR)
    best[half] = 0
    added = np.zeros(size, np.int64)
    added[: n + 1] = cuts + (window + most)
    added <<= 32
    places = np.arange(size)
    found = np.full(size, _FAR)
    found[0] = 0
    gain = np.int64(half) << 32
    for at in range(half, size, half):
        older, newer = best[at - half : at], best[at : at + half]  # places at - M and at - M/2 on
        queue = np.minimum(np.minimum.accumulate(older[::-1])[::-1], np.minimum.accumulate(newer))
        here = np.minimum(queue, newer - gain)
        here += added[at : at + half]
        found[at : at + half] = here
        here &= ~_LOW
        here += places[at : at + half]
        best[at + half : at + 2 * half] = here
    return (found[: n + 1] >> 32) - places[: n + 1], found[: n + 1] & _LOW


def tail_lengths(left: int, most: int, window: int, inside: int) -> tuple[int, list[int]]:
    """Cost and lengths of the windows for the last ``left`` tokens, fewer than ``most``."""
    powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    split = len(powers) * window + max(len(powers) - 1, 0) * inside
    padded = window + most - left
    return (split, powers) if split <= padded or not left else (padded, [left])


def cut_stream(cuts: np.ndarray, most: int, window: int, inside: int, last: bool) -> np.ndarray:
    """Where the windows of a stretch end, ascending; with ``last`` they reach its end."""
    n = len(cuts) - 1
    least, back = window_ends(cuts, most, window)
    low = max(0, n - most + 1)
    if last:
        tails = [tail_lengths(n - j, most, window, inside) for j in range(low, n + 1)]
        at = low + int(np.argmin(least[low:] + np.array([cost for cost, _ in tails])))
        lengths = tails[at - low][1]
    else:
        at, lengths = n - int(np.argmin(least[low:][::-1])), []
    ends, place = [], at
    while place > 0:
        ends.append(place)
        place = int(back[place])
    return np.array([*ends[::-1], *(at + np.cumsum(lengths, dtype=np.int64))], np.int64)


class CachingEncoder(Encoder):
    """An encoder that keeps the ids of the words it met first, ``KEPT_WORDS`` at most."""

    def __init__(self, merges: Merges, classes: np.ndarray):
        super().__init__(merges, None, classes)
        self.known = pa.array([], pa.large_binary())
        self.known_ids, self.known_counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        place = np.asarray(pc.fill_null(pc.index_in(dictionary, value_set=self.known), -1)).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        asked = dictionary.take(pa.array(fresh))
        new_ids, new_counts = super().words(asked)
        all_ids = np.concatenate([self.known_ids, new_ids])
        all_counts = np.concatenate([self.known_counts, new_counts])
        place[fresh] = len(self.known) + np.arange(len(fresh))
        begins = np.cumsum(all_counts) - all_counts
        counts = all_counts[place]
        ids = all_ids[ranges(begins[place], counts)]
        room = KEPT_WORDS - len(self.known)
        if room > 0 and len(fresh):
            short = np.asarray(pc.binary_length(asked)) <= LEXICON_BYTES
            kept = np.flatnonzero(short)[:room]
            self.known_ids = np.concatenate(
                [self.known_ids, new_ids[ranges((np.cumsum(new_counts) - new_counts)[kept], new_counts[kept])]]
            ).astype(np.int32)
            self.known_counts = np.concatenate([self.known_counts, new_counts[kept]])
            self.known = pa.concat_arrays([self.known, asked.take(pa.array(kept))])
        return ids, counts


class Sentences:
    """Which tokens end a sentence, and which begin with a blank, by id."""

    STOPS = (b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode(), "…".encode())

    def __init__(self, tokens: list[bytes]):
        self.stops = np.array([t.rstrip(b"\"')]").endswith(self.STOPS) for t in tokens])
        self.blanks = np.array([t[:1].isspace() for t in tokens])
        self.breaks = np.array([b"\n" in t for t in tokens])

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Per id, whether a sentence ends with it: a stop before a blank, or a line break."""
        found = self.breaks[ids]
        found[:-1] |= self.stops[ids[:-1]] & self.blanks[ids[1:]]
        return found


def encoded(encoder: Encoder, part, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's texts, each text's followed by the end id, and the ids per text."""
    index, by_text, ids, counts = encoder.encode(part)
    begins = np.cumsum(counts) - counts
    flat = ids[ranges(begins[index], counts[index])]
    edges = np.concatenate([[0], np.cumsum(counts[index])])[by_text]
    return np.insert(flat, edges[1:], end_id), np.diff(edges) + 1


def pack(
    docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, window: int = WINDOW,
    after_sentence: int = AFTER_SENTENCE, inside: int = INSIDE, doc_id: str = "doc_id", text: str = "text",
    order: list[str] | None = None, stretch_bytes: int = STRETCH_BYTES,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.  Documents
    come as they are read, or by ``order``, which shuffles them once.  A sequence's number
    is that of its partition, shifted, plus its place in there.
    """
    if max_tokens < 2 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with open(path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, char_classes()))

    def run(batches):
        content, classes = shared.value
        encoder = CachingEncoder(Merges(content), classes)
        sentences = Sentences(encoder.merges.tokens)
        sequence = TaskContext.get().partitionId() << 33
        names, ids = None, np.zeros(0, np.int64)
        # Runs of one document each, in the stretch at hand: row, first id, ids, ids of the document.
        row = first = size = whole = np.zeros(0, np.int64)

        def windows(last):
            nonlocal names, ids, row, first, size, whole, sequence
            run_ends = np.cumsum(size)
            costs = np.full(len(ids) + 1, inside, np.int64)
            costs[1:][sentences.after(ids)] = after_sentence
            costs[run_ends[first + size == whole]] = 0
            ends = cut_stream(costs, max_tokens, window, inside, last)
            done = int(ends[-1]) if len(ends) else 0
            borders = np.unique(np.concatenate([[0], ends, run_ends[run_ends < done]]))
            begin, length = borders[:-1], np.diff(borders)
            holder = np.searchsorted(run_ends, begin, side="right")
            number = np.searchsorted(ends, begin, side="right")
            opens = np.concatenate([[0], ends])[number]
            start = first[holder] + begin - (run_ends - size)[holder]
            data = ids[:done].astype("<u4")
            binary = pa.Array.from_buffers(
                pa.binary(), len(begin), [None, pa.py_buffer((borders * 4).astype(np.int32)), pa.py_buffer(data)]
            )
            out = pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(row[holder])), pa.array(start), pa.array(length), pa.array(whole[holder]),
                    pa.array(sequence + number), pa.array(begin - opens), binary,
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += len(ends)
            keep = run_ends > done
            cut = np.maximum(done - (run_ends - size)[keep], 0)
            first, size, whole = first[keep] + cut, size[keep] - cut, whole[keep]
            names, row = names.take(pa.array(row[keep])), np.arange(len(first))
            ids = ids[done:]
            return out

        for batch in batches:
            for part in slices(batch.column(1), stretch_bytes):
                own, counts = encoded(encoder, part, end_id)
                own_names = batch.column(0).slice(part.first, part.last - part.first)
                row = np.concatenate([row, len(row) + np.arange(len(counts))])
                names = own_names if names is None else pa.concat_arrays([names, own_names])
                first = np.concatenate([first, np.zeros(len(counts), np.int64)])
                size, whole = np.concatenate([size, counts]), np.concatenate([whole, counts])
                ids = np.concatenate([ids, own])
                if len(ids) >= 4 * max_tokens:
                    yield windows(last=False)
        if len(ids):
            yield windows(last=True)

    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
