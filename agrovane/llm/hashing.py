"""Hashes of words and word sequences inside tasks, with numpy over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GOLDEN, _A, _B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


class WordHash(dict):
    """64-bit hash of each word, remembered; forgets all when it holds a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * _A
    x = (x ^ (x >> U64(27))) * _B
    return x ^ (x >> U64(31))


def stream(x: np.ndarray, k: int) -> np.ndarray:
    """Number k of the random stream that belongs to each of ``x``."""
    with np.errstate(over="ignore"):
        return mix(x + U64(k + 1) * _GOLDEN)


def shingles(words: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``length`` words; of the whole sequence where there are fewer words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, length)
    acc = np.full(n - size + 1, size, U64)
    for k in range(size):
        acc = acc * _GOLDEN + words[k : n - size + 1 + k]
    return np.unique(mix(acc))
