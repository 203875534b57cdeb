"""Words of UTF-8 texts as numpy arrays, taken straight from Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is 64 bits wide and
depends on its bytes alone, so it is the same in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are worked through in slices of about this size; one longer text is a slice of its own
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finishing steps of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of at most `limit` bytes of text or one row."""
    texts = batch.column(column)
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    hash: np.ndarray  # of each word
    row: np.ndarray  # the row it stands in
    ptr: np.ndarray  # the words of row i are ptr[i] to ptr[i + 1]
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    data: np.ndarray  # lower-cased bytes


MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # of the first n of eight bytes
EIGHTS = 8  # longest words, in eights of bytes, whose hashes are worked out side by side


class Splitter:
    """Finds words; keeps the powers of the hash's base and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64) for base in (BASE, BASE_INVERSE))
        return self.up, self.down

    def __call__(self, data: np.ndarray, offsets: np.ndarray, ink: np.ndarray | None = None) -> Words:
        """Words of texts given as all their bytes and each text's first byte; none goes across a border.

        `ink` marks the bytes that words are made of, if not all but white space."""
        low = LOWER[data]
        ink = ~SPACE[data] if ink is None else ink
        n = len(data)
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = ink[inner]
        last[inner - 1] = ink[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = self.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        value = (total[end] - total[start]) * down[start]
        ptr = np.searchsorted(start, offsets).astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(ptr))
        return Words(mix(value + (end - start).astype(np.uint64)), row, ptr, start, end, low)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Other hashes of the same words, and where each text's begin: a word is read by eights of bytes, so the work goes with the words, and nothing wider than a byte is made for each byte."""
        n = len(data)
        low = np.frombuffer(data.tobytes().lower() + bytes(8), np.uint8)
        ink = np.zeros(n + 2, bool)  # of the byte before
        np.greater(data - np.uint8(0x09), 4, out=ink[1:-1])
        ink[1:-1] &= data != 0x20
        turns = np.flatnonzero(ink[1:] != ink[:-1])
        start, end = turns[::2], turns[1::2]
        inner = np.unique(offsets[1:-1])
        inner = inner[(inner > 0) & (inner < n)]
        inner = inner[ink[inner] & ink[inner + 1]]
        if len(inner):
            start, end = (np.insert(x, np.searchsorted(x, inner), inner) for x in (start, end))
        size = end - start
        eight = np.ndarray(n + 1, np.dtype("<u8"), low, strides=(1,))
        value = mix((eight[start] & MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE))
        left, at = np.flatnonzero(size > 8), 8
        for i in left[size[left] > 8 * EIGHTS]:
            value[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8).digest(), "little")
        left = left[size[left] <= 8 * EIGHTS]
        while len(left):
            value[left] = mix(value[left] * np.uint64(BASE) + (eight[start[left] + at] & MASK[np.minimum(size[left] - at, 8)]))
            at += 8
            left = left[size[left] > at]
        return value, np.searchsorted(start, offsets).astype(np.int64)


def packed(values: np.ndarray, starts: np.ndarray | None = None) -> pa.Array:
    """Binary column: the bytes of `values`, cut at `starts` (positions of the rows' first values, and the end)."""
    values = np.ascontiguousarray(values)
    starts = np.array([0, len(values)]) if starts is None else starts
    at = (np.asarray(starts) * values.itemsize * (values.size // max(1, len(values)))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column of packed arrays, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    raw = b"" if data is None else data.to_pybytes()[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, dtype), (offsets - offsets[0]) // size
