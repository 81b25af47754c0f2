"""Byte-level helpers shared by the text operators: everything works on the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240917)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes: (first row, last row, their bytes, their offsets from 0). A longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered; runs of anything but 0x20, 0x09-0x0D), and each text's range among them."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev, nxt = np.zeros_like(word), np.zeros_like(word)
    if len(data):
        prev[1:] = word[:-1]
        nxt[:-1] = word[1:]
    begin = np.flatnonzero(word & (~prev | edge[:-1]))
    stop = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    bounds = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), bounds
    length = stop - begin
    at = np.flatnonzero(word)
    first = np.cumsum(length) - length
    rel = np.arange(len(at)) - np.repeat(first, length)
    value = TABLE[LOWER[data[at]]] * powers(int(length.max()))[rel]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * STEP), bounds


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words than ``size`` make one, no words none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    take = min(n, size)
    total = np.zeros(n - take + 1, np.uint64)
    for i, p in enumerate(powers(take + 1)[1:]):
        total += words[i : n - take + 1 + i] * p
    return np.unique(mix(total + np.uint64(take)))
