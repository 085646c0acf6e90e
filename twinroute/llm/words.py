"""Vectorised word kernels shared by the text operators (numpy inside Spark tasks).

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All functions work on
the raw UTF-8 bytes of an Arrow string column, a slice of at most ``CHUNK_BYTES`` at a time
(one longer document forms a slice of its own), so a task's memory does not follow the
partition size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        if size > 8 * CHUNK_BYTES:
            return both[0], both[1]
        have = _powers[base] = (both[0], both[1])
    return have


class SpanHash:
    """Hashes of arbitrary spans of one value array, each in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power, self._inverse = _power(base, n + 1)
        self._sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * power[:n], dtype=_U, out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of a slice: ``start[i]:end[i]`` in ``data``; document d has words ``first[d]:first[d+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None = None

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spans(self) -> SpanHash:
        """Hashes of word sequences by word index."""
        return SpanHash(self.hash, _WORD_BASE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def split(texts: pa.Array, space: np.ndarray = _SPACE, fold=None, hashed: bool = True) -> Words:
    """Words of every text.  ``space``: 256 flags of separator bytes; ``fold``: bytes to bytes."""
    data, offsets = buffers(texts)
    if fold is not None:
        data = fold(data)
    word = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = Words(data, start, end, np.searchsorted(start, offsets))
    if hashed:
        out.hash = SpanHash(data.astype(_U), _BASE).of(start, end)
    return out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``max_bytes`` of text each, one row at least."""
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)


def window_any(flags: np.ndarray, width: int) -> np.ndarray:
    """Covered positions: i is covered when a flagged start lies in (i - width, i]."""
    steps = np.zeros(len(flags) + width + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return np.cumsum(steps)[: len(flags)] > 0
