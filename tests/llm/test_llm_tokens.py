"""Token counts and BPE against brute force and the tokenizer library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from vocabbridge.llm import blocks, bpe, unigram

BYTE_BPE, PIECES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return unigram.Automaton(unigram.load_pieces(PIECES))


def best_path(word: bytes, table):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] - unigram.BYTE_COST * unigram.SCALE, best[end - 1][1] - 1)]
        for begin in range(max(0, end - 64), end):
            if word[begin:end] in table:
                options.append((best[begin][0] + table[word[begin:end]], best[begin][1] - 1))
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_trie_scores(model, words):
    table = dict(unigram.load_pieces(PIECES))
    texts = [w.encode() for w in words[:150]] + ["é中😀".encode(), b"a" * 64, b"ab" * 40, b"\xff", b"the", b"then", b"them"]
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    score, tokens = model.counts(np.frombuffer(b"".join(texts), np.uint8), borders)
    for i, text in enumerate(texts):
        assert (score[i], tokens[i]) == best_path(unigram.WORD_MARK.encode() + text, table)


def test_token_counts(edge_docs, make_docs, model):
    rows = {}
    for row in unigram.count_tokens(edge_docs, PIECES).collect():
        rows.setdefault(row.doc_id, row)
    split = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
    for row in edge_docs.where("doc_id is not null").collect():
        found = [w for w in (row.text or "").translate(split).split(" ") if w]
        tokens = sum(-model.walk((unigram.WORD_MARK + w).encode()) % unigram.TOKENS for w in found[:3000])
        if len(found) <= 3000:
            assert (rows[row.doc_id].n_words, rows[row.doc_id].n_tokens) == (len(found), tokens)
        assert rows[row.doc_id].n_words == len(found)
    assert unigram.count_tokens(make_docs([]), PIECES).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def random_texts():
    draw = random.Random(3)
    parts = ["a", "b", "e", "l", "s", "t", "m", "d", "re", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "!", "é",
             "ß", "中", "😀", "<|endoftext|>", "<|", "\x1c", "\x85", "٣", "aaaa", "''", "՘", "\U00011de0"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(800)]


def test_merges_and_words(library, edge_texts):
    texts = [*random_texts(), *[t for t in edge_texts if t is not None]]
    merges = bpe.Merges(open(BYTE_BPE, encoding="utf-8").read())
    known = sorted({b"a", b"ab", b" aaaa", b"'s", b"  ", b" dup"})
    ids = [np.array(library.encode(w.decode(), add_special_tokens=False).ids) for w in known]
    encoder = bpe.Encoder(merges, bpe.Lexicon.mapped(bpe.Lexicon.build(known, ids).to_bytes()), bpe.char_classes())
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = []
    for part in blocks.slices(pa.array(texts), 1 << 16):
        index, by_text, ids, counts = encoder.encode(part)
        begins = np.cumsum(counts) - counts
        for a, b in zip(by_text[:-1], by_text[1:], strict=True):
            got.append(ids[blocks.ranges(begins[index[a:b]], counts[index[a:b]])].tolist())
    assert got == expected


def test_lexicon(words):
    entries = sorted({w.encode() for w in words})
    ids = [np.arange(i % 4 + 1) + i for i in range(len(entries))]
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(entries, ids).to_bytes())
    assert len(lexicon.final) < sum(len(e) for e in entries)  # suffixes are shared
    asked = [*entries, b"zzz", b"", entries[0] + b"q", entries[5][:1] + b"!"]
    borders = np.concatenate([[0], np.cumsum([len(a) for a in asked])]).astype(np.int64)
    found = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), borders)
    assert found.tolist() == [*range(len(entries)), -1, -1, -1, -1]
    for i in range(len(entries)):
        assert lexicon.ids[lexicon.begin[i] : lexicon.begin[i + 1]].tolist() == ids[i].tolist()


def test_round_trip(edge_docs, make_docs, library):
    rows = [tuple(r) for r in bpe.round_trip(edge_docs, BYTE_BPE).collect()]
    expected = []
    for row in edge_docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        expected.append((row.doc_id, len(ids), *digests))
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert bpe.round_trip(make_docs([]), BYTE_BPE).count() == 0


def test_ids_and_texts(edge_docs, library):
    encoded = bpe.encode(edge_docs, BYTE_BPE)
    for row in encoded.collect():
        assert row.input_ids == library.encode(row.text or "", add_special_tokens=False).ids
    decoded = bpe.decode(encoded.drop("text"), BYTE_BPE).select("doc_id", "text").collect()
    want = sorted((repr(r.doc_id), r.text or "") for r in edge_docs.collect())
    assert sorted((repr(r.doc_id), r.text) for r in decoded) == want
