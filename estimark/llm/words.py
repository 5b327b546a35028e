"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  In UTF-8 these
bytes never occur inside a longer character, so the byte view and the
code-point view agree.  A batch is worked on in slices of about ``SLICE``
bytes (a longer text is a slice of its own), so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from estimark.session import ship_package

SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_TABLE_WORD = np.where(SPACE, np.uint64(0), _TABLE)
_TABLE_LOWER = _TABLE_WORD.copy()
_TABLE_LOWER[65:91] = _TABLE_WORD[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + 1)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
            _inv = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE_INV, np.uint64)], dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hash of each byte span; equal spans get equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h += (ends - starts).astype(np.uint64)
    return mix(h)


@dataclass
class Slice:
    """Rows first..first+n of a batch: their bytes, where each text begins (``offs``, n + 1 entries), the words'
    byte spans, and where each text's words begin (``word_offs``, n + 1 entries)."""

    first: int
    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_offs))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, _TABLE_LOWER if lower else _TABLE_WORD)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes()


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offs.astype(np.int64)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """The column's texts cut into slices of whole texts."""
    if not len(column):
        return
    data, offs = byte_view(column)
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield cut(i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j


def cut(first: int, data: np.ndarray, offs: np.ndarray) -> Slice:
    """Find the words; a text's end also ends its last word."""
    n = len(data)
    if not n:
        return Slice(first, data, offs, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64))
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return Slice(first, data, offs, starts, ends, np.searchsorted(starts, offs))


_STEPS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len(h) - k + 1 of them; none when shorter)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1] * _STEPS[0]
        for j in range(1, k):
            out += h[j: len(h) - k + 1 + j] * _STEPS[j]
    return mix(out)


def windows(s: Slice, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word's index, text's index, hash) of each window of k words that lies inside one text."""
    counts = np.maximum(np.diff(s.word_offs) - k + 1, 0)
    doc = np.repeat(np.arange(s.n), counts)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + s.word_offs[doc]
    all_h = window_hashes(h, k)
    return first, doc, all_h[first] if len(first) else np.empty(0, np.uint64)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in every worker.  Memory that a
    batch no longer needs goes back to the system: workers live on for the
    next stage."""
    ship_package(df.sparkSession)

    def released(batches):
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)
