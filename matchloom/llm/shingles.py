"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Odd multipliers that combine the word hashes of a shingle, by a fixed rule.
_FACTORS = np.array([xxhash.xxh3_64_intdigest(f"factor {i}") | 1 for i in range(16)], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of a word that is kept; longer ones are hashed each time.
KEPT_BYTES = 64


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds `limit` words and keeps no long ones, so its memory is bounded (about 60 MB)."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(word) > KEPT_BYTES:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def codes(self, text: bytes) -> np.ndarray:
        """Hashes of the text's words: A-Z lower-cased, split at U+0020 and U+0009 to U+000D."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combine(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(codes) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += codes[i : i + n] * _FACTORS[i]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def shingle_set(codes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingles; fewer words than `width` are one shingle, no words none."""
    if not len(codes):
        return np.empty(0, np.uint64)
    return np.unique(combine(codes, min(width, len(codes))))
