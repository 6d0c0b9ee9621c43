"""Hashes of many substrings at once, over the bytes of a batch of texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
ROOT = 0x9E3779B97F4A7C15
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(ROOT))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, U)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
    return out


class Substrings:
    """Polynomial hashes of substrings of one byte array, equal for equal bytes wherever
    they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[data] * powers(ROOT, n), out=self.sums[1:])
        self.back = powers(ROOT_INVERSE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        plain = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(plain + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
