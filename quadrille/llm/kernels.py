"""Vectorised text kernels over Arrow string columns, shared by the Arrow-backed operators.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Texts are handled whole, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % 2**64
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step % 2**64
        done += take
    return out[:n]


class Texts:
    """Some texts as one byte buffer, with their words: start, end (bytes) and doc (index of the text) of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1
        solid = ~_SPACE[data]
        head = solid.copy()
        tail = solid.copy()
        if len(data):
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            head[1:] &= ~(solid[:-1] & ~first[1:-1])
            tail[:-1] &= ~(solid[1:] & ~first[1:-1])
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        #: first word of each text, with the number of words at the end
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.count)

    def hashes(self, lower: bool = False, width: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z as a-z; width: of the first so many bytes only."""
        return self.spans(self.start, self.end if width is None else np.minimum(self.end, self.start + width), lower)

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes."""
        if not len(start):
            return np.zeros(0, np.uint64)
        codes = _BYTE_CODE[_LOWER[self.data]] if lower else _BYTE_CODE[self.data]
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(codes * powers(_BASE, len(codes)), out=total[1:])
        return mix64((total[end] - total[start]) * powers(_BASE_INVERSE, len(codes))[start] + np.uint64(1))

    def letters_end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with a last full stop or comma after a letter a-z cut off as a stretch of its own: starts, ends, stretches of each text."""
        last, before = self.data[self.end - 1], _LOWER[self.data[np.maximum(self.end - 2, 0)]]
        cut = ((last == 46) | (last == 44)) & (self.end - self.start > 1) & (before >= 97) & (before <= 122)
        at = np.flatnonzero(cut)
        extra = np.diff(np.r_[0, np.cumsum(cut)][self.first])
        return np.insert(self.start, at + 1, self.end[at] - 1), np.insert(np.where(cut, self.end - 1, self.end), at + 1, self.end[at]), self.count + extra

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Slices of the column with about most_bytes of text each (one longer text is a slice of its own): from, to, Texts. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def rolling(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries of h (len(h)-k+1 of them, across texts too: callers mask those)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(_BASE) + h[j : j + len(out)] + np.uint64(salt + j)) if k <= 8 else out * np.uint64(_BASE) + h[j : j + len(out)]
    return out if k <= 8 else mix64(out + np.uint64(salt))


def segments(first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k words start that lie within one text: their first words, and the number in each text."""
    inside = np.maximum(count - k + 1, 0)
    begin = np.repeat(first[:-1], inside)
    within = np.arange(len(begin)) - np.repeat(np.cumsum(inside) - inside, inside)
    return begin + within, inside


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
