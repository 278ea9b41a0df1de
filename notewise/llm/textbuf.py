"""Vectorised text primitives over Arrow string columns (numpy, no per-character Python).

A column is handled in slices of about ``SLICE_BYTES``; each slice is one
flat array of bytes or code points plus row offsets. Spans (words) are hashed
with one polynomial prefix sum: sum(c_i * P^i) over the slice, multiplied by
P^-start, so that the hash depends on the span's content alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mod_inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def acc(base):
        a = np.full(n, base, dtype=_U)
        a[0] = 1
        return np.multiply.accumulate(a)
    return acc(_P), acc(_mod_inverse(_P))


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * SLICE_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and P^-0.., at least n of each; those of a common slice are kept, those of a longer text are not."""
    return _kept_powers() if n <= 2 * SLICE_BYTES else _powers(n)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span units[start:end]."""
    pw, inv = powers(len(units) + 1)
    pre = np.zeros(len(units) + 1, dtype=_U)
    np.cumsum((units.astype(_U) + _U(1)) * pw[:len(units)], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def slices(col, limit: int = SLICE_BYTES):
    """(first row, bytes as uint8, offsets) for runs of rows of about ``limit`` bytes;
    a longer row makes a run of its own. Null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets to uint32 code points and code point offsets."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(cp) == len(data):
        return cp, off
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[off]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_words(data: np.ndarray, off: np.ndarray, lower: bool = True):
    """Words are runs of bytes other than space and 09-0D (A-Z lower-cased).

    Returns (units, starts, ends, first): words of row r are
    starts[first[r]:first[r + 1]]. A row's end also ends a word."""
    units = _LOWER[data] if lower else data
    solid = ~_SPACE[units]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = off[:-1]
    edge = edge[edge < len(units)]
    begin[edge] = solid[edge]
    stop = np.zeros(len(units) + 1, dtype=bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return units, starts, ends, np.searchsorted(starts, off)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. start + length - 1 of every run, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)
