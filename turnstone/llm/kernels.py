"""Vectorised kernels over the bytes of many texts at once.

Hashes are polynomials modulo 2**64 over prefix sums, so that the hash of any
span costs two look-ups; a finaliser spreads them over all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_tables: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n."""
    if len(_tables[0]) < n:
        for i, m in enumerate((_MULT, _INV)):
            p = np.full(1 << max(21, n.bit_length()), U(m))
            p[0] = 1
            _tables[i] = np.cumprod(p, dtype=U)
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Spans:
    """Hashes of any spans of one sequence of small or 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.power, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum((values.astype(U) + U(1)) * self.power[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k consecutive values."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: max(0, n)]) if n > 0 else np.zeros(0, U)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes but 0x20 and 0x09-0x0D, and each row's first word (with a last bound)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    finish = ~space
    finish[:-1] &= space[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive keys."""
    n = len(keys)
    if n < w:
        return keys[:0]
    if w == 1:
        return keys
    padded = np.full(-(-n // w) * w, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchored_runs(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor.

    The anchor of a window is its rightmost k-gram of least hash, so it depends
    on the window's content alone: equal windows have equal anchors at equal
    places. first: bounds of the rows in the sequence; windows don't cross them.
    Returns the first start, the number of starts, the anchor's place and the row.
    """
    w, n = window - k + 1, len(grams)
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none
    bits = 40  # the same for any length, so that ties of cut hashes fall alike everywhere
    low = U((1 << bits) - 1)
    keys = (mix(grams ^ U(0x5851F42D4C957F2D)) & ~low) | (low - np.arange(n, dtype=U))
    anchor = (low - (sliding_min(keys, w) & low)).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    ok = np.arange(len(anchor)) + window <= first[row + 1]
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    cut = np.flatnonzero(change)
    start, length = cut[:-1], np.diff(cut)
    keep = ok[start]
    start, length = start[keep], length[keep]
    return start, length, anchor[start], row[start]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
