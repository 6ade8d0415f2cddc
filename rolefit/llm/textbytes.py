"""Vectorised word segmentation over Arrow string columns.

A word is a maximal run of bytes other than the six ASCII white-space
characters ``[\\x20\\x09-\\x0D]``.  Everything works on the UTF-8 buffer of a
whole Arrow batch, so the cost per document is independent of Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
#: A random 64-bit value per byte value, and an odd multiplier with its inverse modulo 2**64.
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Words(NamedTuple):
    """Words of a batch, in order: row of each word, byte range in ``data``."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  # first word of each row, and the number of words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls are empty rows."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~WHITE[data]
    edge = inside[1:] != inside[:-1]
    # a row boundary inside a run of non-white bytes both ends a word and starts one
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]]
    marks = np.flatnonzero(edge)
    start, end = marks[0::2], marks[1::2]
    if len(cut):
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
    row = np.searchsorted(offsets, start, side="right") - 1
    bounds = np.searchsorted(start, offsets, side="left")
    return Words(row, start, end, data, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: Bytes hashed at a time: the work arrays hold some 40 bytes for each of them.
SPAN = 1 << 20


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over random byte codes, from prefix sums."""
    out = np.empty(len(w.start), np.uint64)
    first = 0
    while first < len(out):
        # whole words of about SPAN bytes, one at least
        last = max(first + 1, int(np.searchsorted(w.end, w.start[first] + SPAN, side="right")))
        base = w.start[first]
        data = w.data[base: w.end[last - 1]]
        power, inverse = _powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * power[: len(data)], out=prefix[1:])
        s, e = w.start[first:last] - base, w.end[first:last] - base
        out[first:last] = mix((prefix[e] - prefix[s]) * inverse[s])
        first = last
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, at least; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SPAN + 1)
        steps = [np.full(size, x, dtype=np.uint64) for x in (BASE, BASE_INV)]
        for x in steps:
            x[0] = 1
        _POWERS[:] = [np.multiply.accumulate(x) for x in steps]
    return _POWERS[0], _POWERS[1]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of ``batch`` whose texts have about ``limit`` bytes together, one row at least."""
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last
