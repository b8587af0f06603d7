"""Vectorised words, hashes and shingles over the bytes of many texts at once.

A word is a longest run of bytes other than space, tab, \\n, \\v, \\f and \\r.  Hashes are 64 bits: the
sum of byte codes times powers of an odd number (so any span's hash is a difference of running sums),
mixed.  Two given words differ in hash but for a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(U) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; kept for the next call."""
    if len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            out = np.full(size, U(base))
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span of a sequence of 64-bit codes."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(values * up[:n], out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= down[starts]
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a text's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the words of a chunk."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """The hash of each `width` words in a row (across texts too: the caller leaves those out)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(width):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + n]
        out = mix(out)
    return out
