"""Words of whole Arrow batches as numpy arrays.

A batch of texts is one byte buffer with offsets. Word borders, lower-casing and
hashes come from a few vector operations over that buffer, so no Python object
is made for a word. Batches are cut into pieces of bounded bytes first; only a
single longer text makes a longer piece.

A word's hash is a polynomial in its bytes modulo 2^64, mixed with its length.
Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: bytes that end a word under `[^\x20\x09-\x0D]+`
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes that end a word under `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lowered
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[0x30:0x3A] = False
PUNCTUATION[0x61:0x7B] = False
PUNCTUATION[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """``data`` holds the bytes of all texts, ``offsets`` the n + 1 text borders;
    ``start``/``end`` are byte borders of words, ``doc`` their text, and words
    of text i are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def position(self) -> np.ndarray:
        return np.arange(len(self.start)) - self.first[self.doc]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def word(self, j: int) -> bytes:
        return self.data[self.start[j]:self.end[j]].tobytes()

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the (kept) words of every text with one space between two
        words of a text, and their n + 1 borders."""
        idx = np.arange(len(self.start)) if keep is None else np.flatnonzero(keep)
        doc = self.doc[idx]
        length = (self.end[idx] - self.start[idx]).astype(np.int64)
        last = np.ones(len(idx), dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        size = length + ~last
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        out = np.full(total, 0x20, dtype=np.uint8)
        begin = stop - size
        # one gather for all bytes: position in the output minus its word's shift
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(begin, length) + at] = self.data[np.repeat(self.start[idx].astype(np.int64), length) + at]
        per_doc = np.zeros(len(self.offsets), dtype=np.int64)
        np.add.at(per_doc, doc + 1, size)
        return out, np.cumsum(per_doc)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    filled, step = 1, base & MASK
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step & MASK
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    n = len(w.data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * powers(BASE_INVERSE, n)[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, w: Words, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from each word on; only meaningful
    where ``whole(w, size)`` holds."""
    n = len(h)
    out = np.zeros(n, dtype=np.uint64)
    if n >= size:
        m = n - size + 1
        acc = np.zeros(m, dtype=np.uint64)
        for i in range(size):
            acc = acc * np.uint64(BASE) + h[i:i + m]
        out[:m] = mix(acc)
    return out


def whole(w: Words, size: int) -> np.ndarray:
    """Whether ``size`` words of the same text stand from each word on."""
    return np.arange(len(w.start)) + size <= w.first[w.doc + 1]


def single(word: bytes) -> int:
    """The hash of one word, as ``hashes`` gives it."""
    n = len(word)
    data = np.frombuffer(word, dtype=np.uint8)
    w = Words(data, np.array([0, n]), np.array([0]), np.array([n]), np.array([0]), np.array([0, 1]))
    return int(hashes(w)[0])


def split(texts: pa.Array, ends_word: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Find the words of one piece of texts."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset:]
    base, stop = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8, count=stop)[base:] if raw is not None and stop > base else np.zeros(0, np.uint8)
    offsets = offsets - base
    if lower:
        data = LOWER[data]
    inside = ~ends_word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False                     # a text's first byte starts a word
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a piece hold about
    ``PIECE_BYTES`` bytes, or one text if that is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(size):
            continue
        group = (np.cumsum(size) - size) // PIECE_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(size)]):
            yield batch.slice(int(a), int(b - a))


def arrow_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte slices of ``data`` as a binary column."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
