"""Vectorised text work on Arrow batches.

A batch of texts is handled as one byte array with row offsets, in slices of
about ``SLICE`` bytes so that the arrays of a slice stay in cache whatever the
batch holds.  A row is never split: a very long text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
#: For operators whose results don't depend on the slices: a worker's arrays are some 100 times as large.
SMALL = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One odd random multiplier per byte; the base of the polynomial and its inverse modulo 2**64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = U(0xD6E8FEB86659FD93)
_QINV = U(pow(0xD6E8FEB86659FD93, -1, 2**64))
_POWERS: dict[tuple[int, int], np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
IN_WORD = ~SPACES
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once lower-cased
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    size = 1 << max(16, int(n - 1).bit_length()) if n > 1 else 1 << 16
    key = (int(base), size)
    if key not in _POWERS:
        out = np.full(size, base, U)
        out[0] = 1
        _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = texts.buffers()
    offs = np.frombuffer(o, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data, offs


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of whole rows of about ``size`` bytes."""
    data, offs = buffers(texts)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def release() -> None:
    """Give freed memory back to the system: Spark keeps a worker for later tasks, and two kept idle hold what two busy ones need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a release when the task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


class Words:
    """Words of a slice: byte ``starts`` and ``ends``, and ``first``, the word offsets of its rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray = IN_WORD) -> None:
        self.data, self.offs = data, offs
        m = inside[data]
        edges = offs[:-1][offs[:-1] < len(data)]
        before = np.zeros(len(m), bool)
        before[1:] = m[:-1]
        before[edges] = False
        self.starts = np.flatnonzero(m & ~before)
        after = np.zeros(len(m), bool)
        after[:-1] = m[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(m & ~after) + 1
        self.inside = m
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(byte_sums(self.data), self.starts, self.ends)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial, from which any span's hash follows."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * powers(_P, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes."""
    h = (sums[ends] - sums[starts]) * powers(_PINV, len(sums))[starts]
    return mix(h + (ends - starts).astype(U) * _Q)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive symbols, across row borders too (see ``whole``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += h[j : j + n]
    return mix(out)


def whole(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``k`` symbols lie in one row."""
    n = len(rows) - k + 1
    return rows[:n] == rows[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``x`` by row, given the rows' offsets."""
    c = np.zeros(len(x) + 1, np.int64 if x.dtype.kind in "biu" else np.float64)
    np.cumsum(x, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def row_repeats(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of each h: it occurs twice or more in its row; it occurs earlier in its row)."""
    key = mix(h + (rows.astype(U) + U(1)) * _P)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    twice = again.copy()
    twice[order[:-1][same]] = True
    return twice, again


def cover(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a flagged run of ``k`` symbols."""
    d = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    d[at] += 1
    ends = np.bincount(at + k, minlength=n + 1)[: n + 1]
    d -= ends.astype(np.int32)
    return np.cumsum(d[:-1]) > 0
