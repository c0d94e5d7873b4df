"""Byte-level BPE with a lexicon of frequent words.

The tokenizer's file is a parameter.  Texts are split into words by the byte-level
pattern, as array operations over code points.  The words that are most frequent in the
corpus are compiled, with their ids as output, into a minimal acyclic transducer: equal
suffixes share their states, and the numbers on the transitions of a path add up to the
place of the word's ids.  Workers map it into memory from a file of their own.  Other
words go through the merges, all words of a slice at once, exactly.

Nulls and edges: a null text is empty; an empty text has no ids.  The special token's
text is one id wherever it stands.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from vocabbridge.llm.blocks import Slice, frugal, mix, ranges, slices, strings

# Words in the lexicon at most, and the longest, in bytes.
LEXICON_WORDS = 65_536
LEXICON_BYTES = 32
# Bytes of text that are encoded, and counted, at a time.
SLICE_BYTES = 1 << 20
COUNT_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point in the pattern: letter, number, white space, other.

    Unicode versions differ in what they know, so the tokenizer library is asked which
    letters and numbers it joins to a run of their kind.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    index = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for run in regex.finditer(pattern, every):
            table[index[run.start() : run.end()]] = kind
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for before, kind in (("a", LETTER), ("1", NUMBER)):
        asked = index[table[index] == kind]
        pieces = splitter.pre_tokenize_str("".join(before + chr(c) for c in asked))
        begins = np.array([span[0] for _, span in pieces])
        table[asked[(begins[begins % 2 == 1] - 1) // 2]] = OTHER
    return table


def word_borders(part: Slice, classes: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Where the words of a slice begin, in bytes, and the end.

    The pattern: a contraction, or an optional space and a run of letters, of numbers or
    of other characters, or white space; the last white space before a word is that
    word's space if it is one, else a word of its own.
    """
    data = part.data
    if not len(data):
        return np.zeros(1, np.int64)
    wide = bool((data > 127).any())
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32) if wide else data
    at = np.flatnonzero((data & 0xC0) != 0x80) if wide else np.arange(len(data))
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[np.searchsorted(at, part.offsets)] = True
    inside = []
    if special:
        raw, place = data.tobytes(), 0
        while (place := raw.find(special, place)) >= 0:
            first, last = np.searchsorted(at, [place, place + len(special)])
            fresh[first] = fresh[last] = True
            inside.append((first, last))
            place += len(special)
    kinds = classes[points]
    turn = np.empty(n + 1, bool)
    turn[0] = turn[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=turn[1:n])
    turn |= fresh
    starts = turn.copy()
    blank = kinds == SPACE
    # A run of white space that a word follows gives up its last character.
    last_blank = np.flatnonzero(blank & turn[1:] & ~fresh[1:])
    starts[last_blank] = True
    starts[last_blank[points[last_blank] == 32] + 1] = False
    # Contractions: an apostrophe alone that no space precedes, and certain letters.
    quote = np.flatnonzero((points == 39) & starts[:n] & turn[1:] & ~fresh[1:])
    if len(quote):
        padded = np.concatenate([points.astype(np.uint32), np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        two = np.where(fresh[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [115, 116, 109, 100])
        long = np.zeros(len(quote), bool)
        for a, b in (("r", "e"), ("v", "e"), ("l", "l")):
            long |= (one == ord(a)) & (two == ord(b))
        for hits, length in ((quote[short], 2), (quote[long & ~short], 3)):
            starts[hits + 1] = False
            starts[hits + length] = True
    for first, last in inside:
        starts[first + 1 : last] = False
        starts[[first, last]] = True
    return np.append(at, len(data))[np.flatnonzero(starts)]


class IntTable:
    """Integers to their places in a list: open addressing, asked in bulk."""

    def __init__(self, keys: np.ndarray, table: np.ndarray | None = None):
        self.keys = keys
        if table is None:
            bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
            table = np.full(1 << bits, -1, np.int32)
            left = np.arange(len(keys), dtype=np.int32)
            slot = self._slots(keys, len(table))
            while len(left):
                free = table[slot] < 0
                table[slot[free]] = left[free]
                more = table[slot] != left
                left, slot = left[more], (slot[more] + 1) & (len(table) - 1)
        self.table = table

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        bits = size.bit_length() - 1
        return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each integer, -1 if it is not in the list."""
        slot = self._slots(wanted, len(self.table))
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != wanted)) if len(self.keys) else []
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            out[left] = self.table[slot[left]]
            now = out[left]
            left = left[(now >= 0) & (self.keys[np.maximum(now, 0)] != wanted[left])]
        return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges and byte strings of a vocabulary file."""

    def __init__(self, content: str):
        file = json.loads(content)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = file["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in file.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, number in vocab.items():
            tokens[number] = bytes(back[c] for c in token)
        for token, number in self.special.items():
            tokens[number] = token
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = IntTable(left << 20 | right)

    def merge(self, letters: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, back to back, and how many each has.

        Each round merges, in every word, all places of its pair of lowest rank.
        """
        never = len(self.merged)
        word = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        symbol = self.single[letters[borders[0] : borders[-1]]]

        def ranks(at):
            found = self.pairs.find(symbol[at] << 20 | symbol[at + 1]).astype(np.int64)
            return np.where((found < 0) | (word[at] != word[at + 1]), never, found)

        rank = np.full(len(symbol), never)
        if len(symbol) > 1:
            rank[:-1] = ranks(np.arange(len(symbol) - 1))
        done_words, done_symbols = [], []
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            active = best < never
            if not active.all():
                done_words.append(word[~active])
                done_symbols.append(symbol[~active])
                word, symbol, rank, best = word[active], symbol[active], rank[active], best[active]
                if not len(symbol):
                    break
            hit = rank == best
            if (hit[1:] & hit[:-1]).any():  # of overlapping places every other one counts
                places = np.arange(len(hit))
                since = places - np.maximum.accumulate(np.where(hit, -1, places))
                hit &= since % 2 == 1
            chosen = np.flatnonzero(hit)
            symbol[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[chosen]
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            rank[at[at == len(symbol) - 1]] = never
            touched = np.zeros(len(symbol) + 1, bool)  # the last place takes what is before the first
            touched[at] = touched[at - 1] = True
            changed = np.flatnonzero(touched[: max(len(symbol) - 1, 0)])
            rank[changed] = ranks(changed)
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(borders) - 1, np.int64)
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(words, minlength=len(borders) - 1)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, back to back, and how many each has."""
        lengths = self.lengths[ids]
        starts = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self.begins[ids] - starts, lengths)
        return self.bytes[at], lengths


class Lexicon:
    """A minimal acyclic transducer from words to their ids, in flat arrays.

    ``keys`` are the transitions as state * 256 + byte; ``target`` and ``skip`` are the
    state they lead to and the words that come before in order; ``final`` marks states
    in which a word ends.  The sum of the skips of a word's path is its number.
    """

    ARRAYS = ("table", "keys", "target", "skip", "final", "begin", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.transitions = IntTable(self.keys, self.table)

    @classmethod
    def build(cls, words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """``words``: sorted, distinct.  States of finished suffixes are shared at once."""
        known: dict[tuple, int] = {}
        rows: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # open states: final, transitions

        def close(depth):
            while len(path) > depth + 1:
                final, steps = path.pop()
                signature = (final, tuple(steps))
                if signature not in known:
                    known[signature] = len(rows)
                    rows.append(signature)
                byte = path[-1][1][-1][0]
                path[-1][1][-1] = (byte, known[signature])

        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            for byte in word[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        root = len(rows)
        rows.append((path[0][0], tuple(path[0][1])))
        counts = [0] * len(rows)
        keys, target, skip = [], [], []
        for state, (final, steps) in enumerate(rows):  # targets come before their sources
            before = int(final)
            for byte, to in steps:
                keys.append((root - state) << 8 | byte)
                target.append(root - to)
                skip.append(before)
                before += counts[to]
            counts[state] = before
        final = np.array([f for f, _ in rows][::-1], bool)  # the root is state 0
        keys = np.array(keys, np.int64)
        lengths = np.array([len(i) for i in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return cls({
            "table": IntTable(keys).table, "keys": keys, "target": np.array(target, np.int64),
            "skip": np.array(skip, np.int64), "final": final, "begin": begin, "ids": flat,
        })

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, a)) for a in self.ARRAYS]
        head = json.dumps([[a, p.dtype.str, len(p)] for a, p in zip(self.ARRAYS, parts, strict=True)]).encode()
        body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + body

    @classmethod
    def mapped(cls, content: bytes) -> Lexicon:
        """Write the content to a file that vanishes with the process, and map it."""
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(view[:8], "little")
        at, arrays = 8 + size, {}
        for name, kind, count in json.loads(view[8:at]):
            arrays[name] = np.frombuffer(view, np.dtype(kind), count, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def find(self, letters: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon."""
        lengths = np.diff(borders)
        out = np.full(len(lengths), -1, np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES))
        state, number = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        for depth in range(LEXICON_BYTES):
            if not len(alive):
                break
            step = self.transitions.find(state << 8 | letters[borders[alive] + depth])
            ok = step >= 0
            alive, step = alive[ok], step[ok]
            state, number = self.target[step], number[ok] + self.skip[step]
            ends = lengths[alive] == depth + 1
            accepted = ends & self.final[state]
            out[alive[accepted]] = number[accepted]
            alive, state, number = alive[~ends], state[~ends], number[~ends]
        return out


class Encoder:
    """Vocabulary and lexicon of a worker."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, classes: np.ndarray):
        self.merges, self.lexicon, self.classes = merges, lexicon, classes

    def words(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, back to back, and how many each has."""
        n = len(dictionary)
        letters, borders = _flat(dictionary)
        number = self.lexicon.find(letters, borders) if self.lexicon else np.full(n, -1)
        counts = np.zeros(n, np.int64)
        known = np.flatnonzero(number >= 0)
        if len(known):
            counts[known] = np.diff(self.lexicon.begin)[number[known]]
        fixed = {}
        for token, at in self.merges.special.items():
            place = pc.index(dictionary, pa.scalar(token, dictionary.type)).as_py()
            if place >= 0:
                fixed[place] = at
        fresh = number < 0
        fresh[list(fixed)] = False
        fresh = np.flatnonzero(fresh)
        sizes = np.diff(borders)[fresh]
        own = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(own[-1]) + np.repeat(borders[fresh] - own[:-1], sizes)
        fresh_ids, counts[fresh] = self.merges.merge(letters[at], own)
        for place in fixed:
            counts[place] = 1
        begins = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int64)
        ids[ranges(begins[fresh], counts[fresh])] = fresh_ids
        if len(known):
            ids[ranges(begins[known], counts[known])] = self.lexicon.ids[
                ranges(self.lexicon.begin[number[known]], counts[known])
            ]
        for place, value in fixed.items():
            ids[begins[place]] = value
        return ids, counts

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Word numbers, first word of each text, ids per distinct word (flat, counts)."""
        borders = word_borders(part, self.classes, next(iter(self.merges.special), b""))
        found = strings(part.data, borders).dictionary_encode()
        by_text = np.searchsorted(borders[:-1], part.offsets)
        return np.asarray(found.indices), by_text, *self.words(found.dictionary)


def word_counts(docs: DataFrame, text: str, special: bytes) -> DataFrame:
    """``word, n`` over all texts, for words short enough for the lexicon."""
    classes = docs.sparkSession.sparkContext.broadcast(char_classes())

    def count(batches):
        for batch in batches:
            for part in slices(batch.column(0), COUNT_BYTES):
                borders = word_borders(part, classes.value, special)
                found = strings(part.data, borders)
                found = found.filter(pa.array(np.diff(borders) <= LEXICON_BYTES)).value_counts()
                yield pa.RecordBatch.from_arrays(
                    [found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"]
                )

    return docs.select(text).mapInArrow(frugal(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, merges: Merges, text: str = "text") -> Lexicon:
    """The lexicon of the ``LEXICON_WORDS`` most frequent words: the bound of what is collected."""
    special = next(iter(merges.special), b"")
    counted = word_counts(docs, text, special).where(F.col("word") != F.lit(bytearray(special)))
    frequent = counted.orderBy(F.desc("n"), "word").limit(LEXICON_WORDS).select("word").toArrow()
    words = sorted(w for w in frequent.column(0).to_pylist() if w)
    borders = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    ids, counts = merges.merge(np.frombuffer(b"".join(words), np.uint8), borders)
    return Lexicon.build(words, np.split(ids, np.cumsum(counts)[:-1]) if words else [])


_WORKER: dict = {}


def _encoder(vocabulary, lexicon) -> Encoder:
    """The encoder of this worker process, made once per vocabulary and lexicon."""
    key = (vocabulary.value[0], lexicon.value[0])
    if _WORKER.get("key") != key:
        _, content, classes = vocabulary.value
        _WORKER.update(key=key, encoder=Encoder(Merges(content), Lexicon.mapped(lexicon.value[1]), classes))
    return _WORKER["encoder"]


def _shipped(docs: DataFrame, path: str, text: str):
    context = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as file:
        content = file.read()
    packed = compile_lexicon(docs, Merges(content), text).to_bytes()
    digest = [hashlib.sha256(x).hexdigest() for x in (content.encode(), packed)]
    return context.broadcast((digest[0], content, char_classes())), context.broadcast((digest[1], packed))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The ids are hashed in decimal with commas between; the decoded text is put together
    from the ids' bytes.
    """
    vocabulary, lexicon = _shipped(docs, path, text)

    def run(batches):
        encoder = _encoder(vocabulary, lexicon)
        decimals = pa.array([f"{i}," for i in range(len(encoder.merges.tokens))], pa.large_string())
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES):
                index, by_text, ids, counts = encoder.encode(part)
                edges = np.concatenate([[0], np.cumsum(counts)])
                written, ends = _flat(decimals.take(pa.array(ids)))
                all_ids, id_ends = _flat(strings(written, ends[edges]).take(pa.array(index)))
                body, lengths = encoder.merges.decode(ids)
                word_ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
                whole, text_ends = _flat(strings(body, word_ends).take(pa.array(index)))
                before = np.concatenate([[0], np.cumsum(counts[index])])
                hashes = [
                    (
                        hashlib.sha256(all_ids[id_ends[a] : max(id_ends[a], id_ends[b] - 1)]).hexdigest(),
                        hashlib.sha256(_valid(whole[text_ends[a] : text_ends[b]])).hexdigest(),
                    )
                    for a, b in zip(by_text[:-1], by_text[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.last - part.first),
                        pa.array(before[by_text[1:]] - before[by_text[:-1]]),
                        *[pa.array(c, pa.string()) for c in zip(*hashes, strict=True)],
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a binary array with 64-bit offsets."""
    borders = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    body = array.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), borders


def _valid(raw: np.ndarray) -> bytes:
    """The bytes as UTF-8 text, what is none replaced."""
    return raw.tobytes().decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "input_ids") -> DataFrame:
    """``docs`` with the ids of each text as an array ``out``."""
    vocabulary, lexicon = _shipped(docs, path, text)
    docs = docs.select([c for c in docs.columns if c != out])
    kept = docs.columns
    place = kept.index(text)

    def run(batches):
        encoder = _encoder(vocabulary, lexicon)
        for batch in batches:
            for part in slices(batch.column(place), SLICE_BYTES):
                index, by_text, ids, counts = encoder.encode(part)
                begins = np.cumsum(counts) - counts
                flat = ids[ranges(begins[index], counts[index])].astype(np.int32)
                before = np.concatenate([[0], np.cumsum(counts[index])])[by_text].astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(before), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.first, part.last - part.first).columns, arrays], names=[*kept, out]
                )

    fields = docs.withColumn(out, F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(frugal(run), fields)


def decode(rows: DataFrame, path: str, ids: str = "input_ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids as ``out``; null arrays give null."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    vocabulary = rows.sparkSession.sparkContext.broadcast(content)
    kept = [c for c in rows.columns if c != out]
    place = kept.index(ids)

    def run(batches):
        merges = Merges(vocabulary.value)
        for batch in batches:
            texts = [
                None if x is None else b"".join(merges.tokens[i] for i in x).decode("utf-8", "replace")
                for x in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out])

    fields = rows.select(*kept).withColumn(out, F.lit(None).cast("string")).schema
    return rows.select(*kept).mapInArrow(frugal(run), fields)
