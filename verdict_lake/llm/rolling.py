"""Hashes of many substrings at once: sums of unit values times powers of an odd base, modulo 2^64.

Equal unit sequences always get equal hashes, so nothing is missed. Where a hash decides by itself, two of them are used
that differ in their bases and in the units' values, 128 bits in all.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASES = (BASE, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses up to n."""
    for b in (base, pow(base, -1, 1 << 64)):
        if len(_tables.get(b, ())) <= n:
            steps = np.full(1 << max(16, int(n).bit_length()), b, dtype=U)
            steps[0] = 1
            _tables[b] = np.cumprod(steps)
    return _tables[base], _tables[pow(base, -1, 1 << 64)]


def scattered(x: np.ndarray) -> np.ndarray:
    """The values with all bits mixed (the finishing steps of a 64-bit hash)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A value for each byte, and another for the second hash.
BYTE_VALUES, MORE_VALUES = (scattered(np.arange(1, 257, dtype=U) * U(base)) | U(1) for base in BASES)


class Sums:
    """Prefix sums over units, from which any range's hash follows."""

    def __init__(self, units: np.ndarray, base: int = BASE):
        self.power, self.inverse = powers(len(units) + 1, base)
        self.sums = np.zeros(len(units) + 1, dtype=U)
        np.cumsum(units * self.power[: len(units)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scattered((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))

    def of_width(self, width: int) -> np.ndarray:
        """Hashes of all ranges of that many units."""
        n = len(self.sums) - width
        return scattered((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + U(width))


#: The units of a sequence under both hashes.
Units = tuple[np.ndarray, np.ndarray]


class Pair:
    """Both hashes of ranges of a sequence."""

    def __init__(self, units: Units):
        self.first, self.second = (Sums(u, base) for u, base in zip(units, BASES))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first.hashes(starts, ends), self.second.hashes(starts, ends)


def same_as(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of hashes (a, b): a number for each distinct pair, and how many have it."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number, minlength=1)
