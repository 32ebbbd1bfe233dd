"""Fuzzy keys from the binary Golay code of length 23.

The code is perfect: every 23-bit word lies within distance 3 of exactly one of 4,096 codewords. The keys of a word are the indices of
the codewords to which it, or a word one bit away, decodes: one key or six. Two words at distance 2 or less have a word between them
that is one bit away from both, so they always share a key; words a little further apart often do.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
KEYS = 6


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the division by the generator."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK))
    return rest


@lru_cache(maxsize=1)
def _leaders() -> np.ndarray:
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)], np.int64)
    table = np.zeros(1 << CHECK, np.int64)
    table[syndrome(errors)] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword (its 12 message bits)."""
    return (words ^ _leaders()[syndrome(words)]) >> CHECK


def near_indices(words: np.ndarray) -> np.ndarray:
    """Six columns of codeword indices per word; where there are fewer, -1 fills up."""
    flips = np.concatenate(([0], 1 << np.arange(LENGTH, dtype=np.int64)))
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.concatenate((np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]), axis=1)
    out = np.full((len(words), KEYS), -1, np.int64)
    row, column = np.nonzero(fresh)
    out[row, (np.cumsum(fresh, axis=1) - 1)[row, column]] = found[row, column]
    return out
