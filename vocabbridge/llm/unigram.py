"""Token counts under a unigram model, by dynamic programming over a trie of words.

A word is a run of bytes that are no ASCII white space, with the word mark before it.
The distinct words of a slice are sorted, which is their trie: a word adds one node per
byte beyond the prefix it shares with the word before.  Scores are computed once per
node, level by level for all nodes of a level at once: the best score of a prefix is
the best over the pieces that end there.  An automaton over the pieces knows which end
at a node.  The token count of the best path is stored at the word's terminal node, and
a document adds up the counts of its words.

The model is the piece vocabulary of a tokenizer file (a parameter), its ranks turned
into probabilities by a fixed rule, p ~ 1 / (rank + RANK_SHIFT).  Bytes that no piece
covers are one token each at a lower score.  Equal scores go to fewer tokens.

Nulls and edges: a null or blank text has no tokens.  Words of any length are counted
whole.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabbridge.llm.blocks import SLICE_BYTES, slices, strings, words

WORD_MARK = "▁"
RANK_SHIFT = 10
# Scores are integers, 1 / SCALE nats, so that sums do not depend on their order.
SCALE = 1 << 10
# Cost of a byte that no piece covers, in nats.
BYTE_COST = 20
# Score and token count of a path in one integer: score * TOKENS - count.
TOKENS = 1 << 24
# Longer words are walked one by one.
TRIE_BYTES = 64
# Cells (words times bytes) that are worked on together.
CELLS = 1 << 20


def load_pieces(path: str) -> list[tuple[bytes, int]]:
    """The normal pieces of a vocabulary file and their integer scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(model.get_piece_size())))
    for rank in range(model.get_piece_size()):
        if not (model.is_control(rank) or model.is_unknown(rank) or model.is_byte(rank)):
            score = -math.log(rank + RANK_SHIFT) - total
            found[model.id_to_piece(rank).encode()] = round(score * SCALE)
    return sorted(found.items())


class Automaton:
    """Which pieces end after each byte: goto table over byte classes, lists of endings."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        used = sorted({b for piece, _ in pieces for b in piece})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        value, depth = [0], [0]
        for piece, score in pieces:
            node = 0
            for byte in piece:
                step = int(self.classes[byte])
                if step not in children[node]:
                    children[node][step] = len(children)
                    children.append({})
                    value.append(0)
                    depth.append(depth[node] + 1)
                node = children[node][step]
            value[node] = score
        n = len(children)
        self.goto = np.zeros((n, width), np.int32)
        self.score, self.length = np.array(value, np.int64), np.array(depth, np.int64)
        self.ending, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        fall = np.zeros(n, np.int32)
        level = [0]
        while level:
            below = []
            for node in level:
                back = self.goto[fall[node]] if node else np.zeros(width, np.int32)
                self.goto[node] = back
                for step, child in children[node].items():
                    fall[child] = back[step]
                    self.goto[node, step] = child
                    below.append(child)
            for child in below:  # the longest ending at the node, and the next shorter one
                self.shorter[child] = self.ending[fall[child]]
                self.ending[child] = child if value[child] else self.shorter[child]
            level = below

    def walk(self, word: bytes) -> int:
        """Score and count of the best path of one word."""
        best = [0] * (len(word) + 1)
        state = 0
        for place, byte in enumerate(word, 1):
            state = int(self.goto[state, self.classes[byte]])
            top = best[place - 1] - BYTE_COST * SCALE * TOKENS - 1
            end = int(self.ending[state])
            while end:
                top = max(top, best[place - int(self.length[end])] + int(self.score[end]) * TOKENS - 1)
                end = int(self.shorter[end])
            best[place] = top
        return best[-1]

    def trie(self, letters: np.ndarray) -> np.ndarray:
        """Scores of sorted words: ``letters`` has a word per row, -1 after its end.

        The result has the best path of every word's prefix; a prefix shared with the
        row before is computed once, at the first row that has it.
        """
        n, longest = letters.shape
        best = np.zeros((longest + 1, n), np.int64)
        state = np.zeros(n, np.int32)
        first = np.zeros(n, np.int64)  # the row that computes this row's prefix
        rows = np.arange(n)
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        for place in range(1, longest + 1):
            byte = letters[:, place - 1]
            fresh[1:] |= byte[1:] != byte[:-1]
            nodes = np.flatnonzero(fresh & (byte >= 0))
            first = np.maximum.accumulate(np.where(fresh, rows, 0))
            at = self.goto[state[nodes], self.classes[byte[nodes]]]
            top = best[place - 1, nodes] - (BYTE_COST * SCALE * TOKENS + 1)
            end, left = self.ending[at], np.arange(len(nodes))
            while True:
                some = end > 0
                if not some.any():
                    break
                left, end = left[some], end[some]
                score = best[place - self.length[end], nodes[left]] + self.score[end] * TOKENS - 1
                top[left] = np.maximum(top[left], score)
                end = self.shorter[end]
            state[nodes] = at
            best[place, nodes] = top
            state, best[place] = state[first], best[place, first]
        return best

    def counts(self, letters: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and token count of each distinct word (bytes back to back)."""
        mark = np.frombuffer(WORD_MARK.encode(), np.uint8)
        lengths = np.diff(borders)
        out = np.zeros(len(lengths), np.int64)
        for i in np.flatnonzero(lengths > TRIE_BYTES):
            out[i] = self.walk(WORD_MARK.encode() + letters[borders[i] : borders[i + 1]].tobytes())
        short = np.flatnonzero(lengths <= TRIE_BYTES)
        order = short[_sorted(letters, borders, short)]
        at = 0
        while at < len(order):
            take = order[at : at + max(1, CELLS // (TRIE_BYTES + len(mark)))]
            size = lengths[take]
            wide = int(size.max())
            table = np.full((len(take), wide + len(mark)), -1, np.int16)
            table[:, : len(mark)] = mark
            inside = np.arange(wide) < size[:, None]
            table[:, len(mark) :][inside] = letters[(borders[take][:, None] + np.arange(wide))[inside]]
            best = self.trie(table)
            out[take] = best[size + len(mark), np.arange(len(take))]
            at += len(take)
        tokens = -out % TOKENS
        return (out + tokens) // TOKENS, tokens


def _sorted(letters: np.ndarray, borders: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The order of the chosen words by their bytes."""
    return np.asarray(pc.sort_indices(strings(letters, borders).take(pa.array(chosen))))


@lru_cache(maxsize=2)
def _automaton(pieces: tuple) -> Automaton:
    return Automaton(list(pieces))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_tokens, score`` (nats)."""
    pieces = docs.sparkSession.sparkContext.broadcast(tuple(load_pieces(path)))

    def run(batches):
        model = _automaton(pieces.value)
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES):
                found = words(part)
                encoded = strings(found.letters, found.borders).dictionary_encode()
                distinct = encoded.dictionary
                borders = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
                body = distinct.buffers()[2]
                letters = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
                score, tokens = model.counts(letters, borders)
                index = np.asarray(encoded.indices)
                sums = [np.concatenate([[0], np.cumsum(x[index])])[found.by_text] for x in (tokens, score)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.last - part.first),
                        pa.array(np.diff(found.by_text)),
                        pa.array(np.diff(sums[0])),
                        pa.array(np.diff(sums[1]) / SCALE),
                    ],
                    names=["doc_id", "n_words", "n_tokens", "score"],
                )

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, score double")
