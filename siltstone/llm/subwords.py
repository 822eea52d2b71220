"""Vectorised character n-grams of words, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

FRONT, BACK = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed(codes: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points, as `Padded.grams` makes them."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h *= _PRIME
        h += codes[:, k]
    return _mixed(h)


class Padded:
    """Words laid out one after another in one array of code points, with marks before and after each."""

    def __init__(self, words: list[str], front: int = 1):
        text = "".join(f"{FRONT * front}{w}{BACK}" for w in words)
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.sizes = np.fromiter((len(w) + front + 1 for w in words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where every window of n code points inside a word begins, and the number of the word that each is in."""
        counts = np.maximum(self.sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[owner], owner

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every window of n code points inside a word, and the number of the word that each is in."""
        at, owner = self.windows(n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h *= _PRIME
            h += self.codes[at]
            at += 1
        return _mixed(h), owner
