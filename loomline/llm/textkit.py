"""Words and their hashes for whole Arrow batches at once, without a Python loop over words.

Words are runs of bytes other than space and tab to carriage return; lower-casing touches A-Z only. A word's hash is a polynomial in
its bytes modulo 2**64, taken from prefix sums over the buffer and mixed, so that a batch costs a few passes of numpy over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is one slice of its own.
SLICE = 1 << 19
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)
_C_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(text: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows with about size bytes. Null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary()).fill_null(b"")
    n = len(text)
    if not n:
        return
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and for each row the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    inner = off[(off > 0) & (off < n)]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[data] if lower else data] * powers(_B, n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        h = (total[ends] - total[starts]) * powers(_B_INV, n)[starts]
    return mix(h), np.searchsorted(starts, off)


def grams(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words that stay within a row, and their start among all words."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(h * powers(_C, n), out=total[1:])
        g = (total[size:] - total[:-size]) * powers(_C_INV, n - size + 1)
    ok = np.ones(n - size + 1, bool)
    ends = bounds[1:-1]
    ends = ends[(ends > 0) & (ends < n)]
    for k in range(1, size):  # starts whose run crosses into the next row
        at = ends - k
        ok[at[(at >= 0) & (at <= n - size)]] = False
    starts = np.flatnonzero(ok)
    return mix(g[starts]), starts


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class HashIndex:
    """Positions of 64-bit hashes in a sorted array, by an open-addressed table; about as many steps for a million keys as for ten."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        n = np.arange(len(keys))
        at = n + np.maximum.accumulate(slot - n) if len(keys) else slot
        self.table = np.full((1 << self.bits) + len(keys) + 2, -1, np.int32)
        self.table[at] = n

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            got = self.table[slot]
            same = (got >= 0) & (self.keys[got] == h[left])
            out[left[same]] = got[same]
            go = (got >= 0) & ~same
            left, slot = left[go], slot[go] + 1
        return out


def spans(data: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes that are not apart (a table of 256 flags) and stay within a row, and for each row the number of runs before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = apart[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, gap[:-1]
    inner = off[(off > 0) & (off < n)]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, gap[1:]
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~gap)
    return starts, np.flatnonzero(last & ~gap) + 1, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes: equal bytes, equal hash."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_B, len(data)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(_B_INV, len(data) + 1)[starts])
