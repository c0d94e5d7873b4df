"""Numpy views of text columns: slices of bounded size, words, word hashes.

A slice holds whole texts, back to back, so kernels run over bytes and not over rows.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in slices of about this many bytes; a longer text is a slice alone.
SLICE_BYTES = 2 << 20

# ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Slice:
    """Rows ``first`` to ``last`` (end exclusive) of a batch: bytes and text borders."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(texts, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def spread(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, how many of the ascending positions ``flags`` lie before its borders."""
    return np.searchsorted(flags, offsets)


def frugal(run: Callable) -> Callable:
    """A function over batches that gives unused memory back when its partition ends.

    Python workers live on between stages, and allocators keep what a task has freed.
    """

    @wraps(run)
    def through(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc only
            trim(0)

    return through


@dataclass
class Words:
    """Runs of bytes that are no ASCII white space, over one slice.

    ``letters`` are their bytes back to back, ``borders`` where each begins there (and
    the end), ``starts`` where they begin in the slice, ``by_text`` the first word of
    each text (and the end).
    """

    letters: np.ndarray
    borders: np.ndarray
    starts: np.ndarray
    by_text: np.ndarray


def words(part: Slice) -> Words:
    """The words of a slice."""
    dark = ~SPACE[part.data]
    n = len(dark)
    begin, end = dark.copy(), dark.copy()
    if n:
        begin[1:] &= ~dark[:-1]
        end[:-1] &= ~dark[1:]
        inner = part.offsets[(part.offsets > 0) & (part.offsets < n)]
        begin[inner] = dark[inner]
        end[inner - 1] = dark[inner - 1]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(end) + 1 - starts
    borders = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=borders[1:])
    return Words(part.data[dark], borders, starts, spread(starts, part.offsets))


def strings(letters: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Byte runs as an Arrow binary array that shares the buffers."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(borders) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(np.ascontiguousarray(letters))],
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(found: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if ``lower``."""
    borders = found.borders
    if len(borders) == 1:
        return np.zeros(0, np.uint64)
    lengths = np.diff(borders)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    np.cumprod(powers, out=powers)
    place = np.arange(borders[-1]) - np.repeat(borders[:-1], lengths)
    letters = _LOWER[found.letters] if lower else found.letters
    values = (letters.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(values, borders[:-1]) + lengths.astype(np.uint64))


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, ``counts`` of them, back to back."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - ends + counts, counts)
