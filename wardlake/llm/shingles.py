"""Hashes of words and shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MANY = 500_000


class WordHashes(dict):
    """64-bit hashes of words (bytes); a bounded table, since most words come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MANY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; lower: A-Z alone are lower-cased."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return (body.lower() if lower else body).split()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words; fewer words make none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * factor + h[i : i + n]
    return mix(out, k)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle, no words none."""
    if 0 < len(h) < k:
        return windows(h, len(h))
    return np.unique(windows(h, k))
