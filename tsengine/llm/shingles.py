"""Word shingles of a text as numbers."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle

# Task code travels with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Odd multipliers of 64-bit mixing.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
REMEMBERED = 100_000


class WordHashes(dict):
    """Hash of a word, remembered; forgets everything before it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combines two arrays of 64-bit values."""
    x = (a * MIX_A) ^ b
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; fewer words are one shingle, none are none.

    Words are what ASCII white space separates, with ASCII letters in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(size, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc, hashes[i : n - k + 1 + i])
    return np.unique(acc)
