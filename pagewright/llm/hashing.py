"""Vectorised polynomial hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd multiplier, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, x in enumerate((BASE, INVERSE)):
            p = np.full(size, x, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = hash of data[i:j] times BASE**i, modulo 2**64."""
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=s[1:])
    return s


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash and row of every word (a run of bytes other than 9 to 13 and 32); words end at row ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix(data)
    _, inv = powers(n + 1)
    h = mix((sums[e] - sums[s]) * inv[s])
    row = np.searchsorted(offsets, s, side="right") - 1
    return s, e, h, row


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words within a row."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(h) - n + 1
    x = h[:m].copy()
    for k in range(1, n):
        x = x * U(0xD6E8FEB86659FD93) + h[k : k + m]
    ok = row[:m] == row[n - 1 :]
    return mix(x[ok]), row[:m][ok]
