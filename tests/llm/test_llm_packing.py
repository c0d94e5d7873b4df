"""Packing against brute force and the tokenizer library."""

import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from vocabbridge.llm import packing

BYTE_BPE = path("byte_bpe_50k.json")


def padding(length, most):
    return 0 if length & (length - 1) == 0 else most - length


def least_costs(cuts, most, window):
    """The recurrence itself, window by window."""
    best = [0] + [None] * (len(cuts) - 1)
    for end in range(1, len(cuts)):
        options = [
            best[end - length] + cuts[end] + window + padding(length, most)
            for length in range(most // 2, most + 1)
            if end >= length and best[end - length] is not None
        ]
        best[end] = min(options, default=None)
    return best


@pytest.mark.parametrize("most", [2, 4, 8, 16])
def test_window_ends(most):
    draw = random.Random(most)
    for n in [*range(25), 90, 200]:
        cuts = np.array([draw.choice([0, 2, 8]) for _ in range(n + 1)], np.int64)
        least, back = packing.window_ends(cuts, most, 4)
        expected = least_costs(cuts.tolist(), most, 4)
        for place, cost in enumerate(expected):
            if cost is None:
                assert least[place] > 1 << 24
            else:
                assert least[place] == cost
            if place and cost is not None:
                length = place - back[place]
                assert least[back[place]] + cuts[place] + 4 + padding(length, most) == cost


@pytest.mark.parametrize("most", [4, 16])
def test_whole_streams_cost_least(most):
    draw = random.Random(9)
    for n in [1, 2, 3, 7, 40, 75]:
        cuts = np.array([draw.choice([0, 2, 8]) for _ in range(n + 1)], np.int64)
        ends = packing.cut_stream(cuts, most, 4, 8, last=True)
        assert ends[-1] == n and (np.diff(ends, prepend=0) <= most).all()
        best = least_costs(cuts.tolist(), most, 4)
        options = [
            best[j] + packing.tail_lengths(n - j, most, 4, 8)[0]
            for j in range(max(0, n - most + 1), n + 1)
            if best[j] is not None
        ]
        reached = []
        for j in [0, *ends.tolist()]:
            cost, lengths = packing.tail_lengths(n - j, most, 4, 8) if n - j < most else (0, None)
            if best[j] is not None and np.diff(ends[ends >= j], prepend=j)[j > 0 :].tolist() == lengths:
                reached.append(best[j] + cost)
        assert min(options) in reached


def pieces_by_document(rows):
    found = {}
    for row in rows:
        found.setdefault(row.doc_id, []).append(row)
    return found


@pytest.mark.parametrize("stretch", [400, 1 << 20])
def test_pieces_hold_every_id_once(make_docs, edge_texts, stretch):
    texts = [*edge_texts, "One sentence. Another one! A third?\nA line" * 30]
    docs = make_docs(texts).repartition(3)
    rows = packing.pack(docs, BYTE_BPE, max_tokens=64, stretch_bytes=stretch).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    found = pieces_by_document(rows)
    assert sorted(found) == list(range(len(texts)))
    for doc_id, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for row in sorted(found[doc_id], key=lambda r: r.start):
            assert (row.start, row.doc_tokens) == (at, len(ids))
            assert np.frombuffer(row.ids, "<u4").tolist() == ids[at : at + row.length]
            at += row.length
        assert at == len(ids)
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    padded = total = 0
    for parts in sequences.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 64
        padded, total = padded + padding(place, 64), total + place
    assert padded < 0.05 * total


def test_order_ties_nulls_and_empty(spark, make_docs):
    texts = ["b b", None, "a a", "b b"]
    docs = make_docs(texts, [2, None, 1, 2])
    rows = packing.pack(docs, BYTE_BPE, order=["doc_id"]).collect()
    in_order = sorted((r for r in rows if r.start == 0), key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in in_order] == [None, 1, 2, 2]
    assert packing.pack(make_docs([]), BYTE_BPE).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, BYTE_BPE, max_tokens=1000)


def test_sentences():
    tokens = [b"word", b".", b" Next", b"\n", b".\"", b"3"]
    sentences = packing.Sentences(tokens)
    ids = np.array([0, 1, 2, 0, 3, 1, 5, 4, 2])
    assert sentences.after(ids).tolist() == [False, True, False, False, True, False, False, True, False]


def test_query(spark):
    from vocabbridge.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = pieces_by_document(queries.op11_packing(spark, folder).collect())
    library = Tokenizer.from_file(BYTE_BPE)
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array([*library.encode(doc.text, add_special_tokens=False).ids, 0], "<u4")
        for row in rows[doc.doc_id]:
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
        assert sum(r.length for r in rows[doc.doc_id]) == len(ids) == rows[doc.doc_id][0].doc_tokens
