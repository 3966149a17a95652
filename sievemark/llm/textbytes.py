"""Vectorised views of Arrow text columns: words, rolling hashes and per-document sums in numpy.

Every helper works on whole texts. Rows are handled in slices of a bounded number of bytes, so the memory of a
task doesn't depend on the number of rows; only one text longer than the bound is a slice by itself.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _NGRAM_BASE = 0x100000001B3, 0xD6E8FEB86659FD93


def byte_class(keep) -> np.ndarray:
    """A table of 256 booleans, from a predicate on byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


SPACES = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class(lambda b: b not in SPACES)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, A-Z counted as their lower case
WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: close inputs get unrelated outputs."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def releasing(run: Callable) -> Callable:
    """A function of batches that gives freed memory back to the system when its task ends: a worker that waits for its next
    task then holds little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse; they grow on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                full = np.full(size, b, np.uint64)
                full[0] = 1
                setattr(self, name, np.cumprod(full, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_NGRAM_BASE)


class Texts(NamedTuple):
    """Consecutive rows of a batch: their bytes, and where each row begins (and the last one ends)."""

    first: int
    data: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string column in slices of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield Texts(low, data[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


class Spans(NamedTuple):
    """Half-open byte spans of words; `of` has the range of words of each row, `row` the row of each word."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    row: np.ndarray


def spans(t: Texts, member: np.ndarray) -> Spans:
    """Maximal runs of bytes in the class `member`, never across rows."""
    inside = np.zeros(len(t.data) + 1, bool)
    inside[:-1] = member[t.data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[t.at] = False  # a row's first byte has nothing before it
    start = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[t.at[1:] - 1] = False  # nor its last byte anything after
    end = np.flatnonzero(inside & ~after) + 1
    of = np.searchsorted(start, t.at)
    return Spans(start, end, of, np.repeat(np.arange(t.rows), np.diff(of)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one polynomial prefix sum over all of them."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive words; windows that leave a row are for the caller to mask."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[n:] - sums[:m]) * down[:m])


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over each row; `at` has the rows' bounds among the values."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, 0 if it stands once, 1 if it is the first of several, 2 if a later one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.where(same[:-1], 2, np.where(same[1:], 1, 0))
    return out
