"""The binary Golay code of length 23 as a fuzzy hash.

The code is perfect: every 23-bit vector is within three errors of exactly one of the 4,096 codewords. A
vector at distance three from its codeword has five more codewords at distance four. If two vectors differ
in one bit, the codeword of each is among these one or six of the other, so they meet in a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH = 23
#: Fixed value: the generator polynomial, bit k for the power k.
GENERATOR = 0b110001110101
_CHECK_BITS = 11


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper bits, the error of each syndrome, and its five errors of weight four (or -1)."""
    remainder = np.arange(1 << (LENGTH - _CHECK_BITS), dtype=np.int64) << _CHECK_BITS
    for bit in range(LENGTH - 1, _CHECK_BITS - 1, -1):
        remainder ^= np.where(remainder >> bit & 1, GENERATOR << (bit - _CHECK_BITS), 0)

    def patterns(weight: int) -> np.ndarray:
        return np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], dtype=np.int64)

    def syndrome(x: np.ndarray) -> np.ndarray:
        return (x & ((1 << _CHECK_BITS) - 1)) ^ remainder[x >> _CHECK_BITS]

    error = np.zeros(1 << _CHECK_BITS, dtype=np.int64)
    for weight in (1, 2, 3):
        found = patterns(weight)
        error[syndrome(found)] = found
    far = patterns(4)
    of = syndrome(far)
    order = np.argsort(of, kind="stable")
    further = np.full((1 << _CHECK_BITS, 5), -1, dtype=np.int64)
    further[of[order].reshape(-1, 5)[:, 0]] = far[order].reshape(-1, 5)
    return remainder, error, further


def codewords(vectors: np.ndarray) -> np.ndarray:
    """Indices (0 to 4,095) of the codewords of each 23-bit vector: its own, and five more or -1."""
    remainder, error, further = _tables()
    x = vectors.astype(np.int64)
    syndrome = (x & ((1 << _CHECK_BITS) - 1)) ^ remainder[x >> _CHECK_BITS]
    out = np.empty((len(x), 6), dtype=np.int64)
    out[:, 0] = (x ^ error[syndrome]) >> _CHECK_BITS
    more = further[syndrome]
    out[:, 1:] = np.where(more < 0, -1, (x[:, None] ^ more) >> _CHECK_BITS)
    return out
