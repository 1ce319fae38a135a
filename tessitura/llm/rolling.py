"""Rolling hashes over many documents at once, in numpy.

All arithmetic is modulo 2**64. A polynomial hash of the tokens [i, i + n) is ``(S[i + n] - S[i]) * B**-i`` with ``S`` the running sum
of token * B**j; B is odd and so has an inverse. Tokens are mixed to random-looking words first.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


class Prefix:
    """Hashes of any stretch of a token sequence."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(tokens * powers(BASE, n), dtype=U, out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def every(self, n: int) -> np.ndarray:
        """Hashes of all stretches of ``n`` tokens."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each stretch of ``n``."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and hashes of the words (bytes other than space and 9-13) of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    return start, stop, Prefix(mix(b.astype(U), 7)).of(start, stop)
