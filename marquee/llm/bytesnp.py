"""Vectorised helpers over the UTF-8 bytes of many texts at once.

Texts of one batch lie in one uint8 buffer with int64 offsets. Words and longer
slices are hashed eight bytes at a time by a chain of mixed words. Windows of at
most some hundred bytes (:class:`Hasher`) come from one prefix sum of a
polynomial modulo 2**64, which structured strings of a thousand bytes could
fool and shorter ones cannot. A hash depends on the bytes alone, never on their
place.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(kind: str, n: int) -> np.ndarray:
    base = _R if kind == "up" else _RINV
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[kind] = have = out
    return have[:n]


class Hasher:
    """Hashes of short windows of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.empty(n + 1, dtype=np.uint64)
        self.prefix[0] = 0
        np.cumsum(_TABLE[buf] * _power("up", n), out=self.prefix[1:])
        self._down = _power("down", n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed polynomial values of buf[start:end]."""
        return (self.prefix[end] - self.prefix[start]) * self._down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k-byte string, by its start."""
        if len(self.prefix) <= k:
            return np.empty(0, dtype=np.uint64)
        return mix((self.prefix[k:] - self.prefix[:-k]) * self._down[: len(self.prefix) - k])


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... bytes of every row of a matrix of short rows."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum(_TABLE[rows] * _power("up", rows.shape[1]), axis=1, out=out[:, 1:])
    return mix(out)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 256  # bytes beyond which the words of a slice are summed instead of chained


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of buf[start:end]; those of another salt are independent."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    at8 = np.ndarray((len(buf) + 1,), "<u8", wide, 0, (1,))  # the eight bytes from every place
    size = end - start
    out = mix(size.astype(np.uint64) * _M1 + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    open_ = np.flatnonzero((size > 0) & (size <= _LONG))
    done = 0
    while len(open_):
        left = size[open_] - done
        lane = at8[start[open_] + done] & _KEEP[np.minimum(left, 8)]
        out[open_] = mix(out[open_] * _R ^ lane)
        done += 8
        open_ = open_[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        at = np.arange(start[i], end[i], 8)
        lane = at8[at] & _KEEP[np.minimum(end[i] - at, 8)]
        key = mix(np.arange(1, len(at) + 1, dtype=np.uint64) * _R + out[i])
        out[i] = mix(np.array([np.add.reduce(mix(mix(lane ^ key) + key))], np.uint64) + out[i])[0]
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (with the end)."""
    solid = ~_SPACE[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = True
    edge[-1] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = solid[start] if len(start) else np.empty(0, dtype=bool)
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


def window_min_positions(values: np.ndarray, w: int) -> np.ndarray:
    """Where the (leftmost) least of each window of w values lies, one per window."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, span = values, 1
    while 2 * span <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    least = np.minimum(best[:n], best[w - span : w - span + n])
    # the leftmost place: candidates equal their own window's least
    return least
