"""The binary Golay code (23, 12, 7) as a fuzzy hash.

The code is perfect: every 23-bit word lies at distance 3 or less of exactly one codeword, whose 12 message bits are the
word's index. near() gives the indices of a word and of all words one bit away, 1 or up to 6 different ones. Two words one
bit apart: the index of either is among near() of the other. Two words two bits apart: near() of both share an index, that
of the word between them. Shorter words are padded with zeros, and only their own bits are flipped.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits by message, and the error of least weight by syndrome."""
    checks = np.array([_remainder(m << CHECK_BITS) for m in range(1 << (LENGTH - CHECK_BITS))], np.int32)
    errors = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            errors[_remainder(error)] = error
    return checks, errors


def index(words: np.ndarray) -> np.ndarray:
    """The message bits of the nearest codeword."""
    checks, errors = _tables()
    words = words.astype(np.int32)
    return (words ^ errors[checks[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))]) >> CHECK_BITS


def near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of indices for each word of so many bits, sorted, and which of a row's entries are not repeats."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    found = np.sort(index(words.astype(np.int32)[:, None] ^ flips), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh
