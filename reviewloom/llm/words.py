"""Words of Arrow text batches as numpy arrays, without a Python loop over words.

A word is a maximal run of bytes that are not ASCII white space (``[^\\x20\\x09-\\x0D]+``); A-Z count as a-z.
White space is ASCII, so cutting the UTF-8 bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
SLICE_BYTES = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """What is written within this gets its Python tasks' rows in batches of about ``size``: for wide rows."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM_ONLY = np.ones(256, bool)
_ALNUM_ONLY[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _ALNUM_ONLY[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply, as in splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_STEP = U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _STEP))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP))
    return _POWERS


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), order kept."""
    return mix(a * U(0xD6E8FEB86659FD93) + b + U(0x632BE59BD9B4E019))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    off = offsets(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(end, len(texts))
        at = min(end, len(texts))


def strings(column) -> pa.Array:
    """A text column with nulls as empty texts and 32-bit offsets where they fit."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts in them (one more entry than rows)."""
    off = offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of some rows: byte ranges, 64-bit hashes, and the first word of each row (one more entry than rows)."""

    def __init__(self, texts: pa.Array, letters_only: bool = False):
        data, off = raw(texts)
        gap = (_ALNUM_ONLY if letters_only else _SPACE)[data]
        edge = np.zeros(len(data) + 1, bool)  # a word may start here
        edge[off] = True
        edge[1:] |= np.concatenate((gap, [True]))[:-1]
        inside = ~gap
        self.start = np.flatnonzero(inside & edge[:-1])
        edge = np.zeros(len(data) + 1, bool)  # a word may end here
        edge[off] = True
        edge[:-1] |= gap
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        self.data = _LOWER[data]
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U)
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size)  # position in its word
        chars = self.data[at + np.repeat(self.start, size)]
        sums = np.add.reduceat(_BYTE[chars] * _powers(int(size.max()))[at], ends - size)
        return mix(sums + size.astype(U))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` consecutive words, and the first of each row; fewer words: the whole sequence as one; none: none."""
        n = np.diff(self.first)
        count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
        first = np.concatenate(([0], np.cumsum(count)))
        row = np.repeat(np.arange(len(n)), count)
        at = np.arange(first[-1]) - first[row] + self.first[row]
        size = np.minimum(n, width)[row]
        out = mix(self.hash[at] + size.astype(U)) if len(at) else np.zeros(0, U)
        for k in range(1, width):
            more = size > k
            if more.all():
                out = joined(out, self.hash[at + k])
            else:
                out[more] = joined(out[more], self.hash[at[more] + k])
        return out, first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from where each row starts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
