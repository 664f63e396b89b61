"""Vectorised kernels over the bytes of many texts at once.

Texts stand one after the other in one byte buffer; ``starts`` holds where each
begins, with the buffer's length last.  Fingerprints are 64-bit polynomial
hashes modulo 2**64 over random byte values, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, U)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = (both[0], both[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running hash sums, one longer than ``values``."""
    p, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [begin, end) under ``sums = prefix_hashes(...)``."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin])


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive values."""
    if len(values) < size:
        return np.zeros(0, U)
    sums = prefix_hashes(values)
    _, inverse = powers(len(values))
    return mix((sums[size:] - sums[:-size]) * inverse[: len(values) - size + 1])


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buf]


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of its text."""
    letter = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = True
    opens = letter.copy()
    opens[1:] &= ~letter[:-1] | edge[1:-1]
    closes = letter.copy()
    closes[:-1] &= ~letter[1:] | edge[1:-1]
    begin = np.flatnonzero(opens)
    return begin, np.flatnonzero(closes) + 1, np.searchsorted(starts, begin, "right") - 1


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(byte_values(buf)), begin, end)


def sliding(function, values: np.ndarray, size: int) -> np.ndarray:
    """``function`` (minimum or maximum) of every ``size`` consecutive values."""
    out, width = values, 1
    while width * 2 <= size:
        out = function(out[:-width], out[width:])
        width *= 2
    if width < size:
        out = function(out[: len(out) - (size - width)], out[size - width :])
    return out


def whole_windows(owner: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` values lie within one owner."""
    if len(owner) < size:
        return np.zeros(0, bool)
    return owner[: len(owner) - size + 1] == owner[size - 1 :]


def covered(hit: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` values some window with ``hit`` set covers."""
    hit = hit[: max(0, n - size + 1)]
    change = np.zeros(n + size + 1, np.int32)
    change[: len(hit)] += hit
    change[size : size + len(hit)] -= hit
    return np.cumsum(change[:n]) > 0


def group_sorted(keys: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of ``keys`` and the begin of each run of equal keys."""
    order = np.argsort(keys, kind="stable" if stable else None)
    k = keys[order]
    if not len(k):
        return order, np.zeros(0, np.int64)
    return order, np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
