"""Word n-grams as 64-bit numbers, computed over whole batches with numpy inside tasks."""

from __future__ import annotations

import numpy as np

KEEP_WORDS = 200_000
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to KEEP_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEEP_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-grams of word hashes, ascending; fewer words are one n-gram, none are none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        h = scramble(h * np.uint64(FACTORS[i]) + words[i : len(words) - n + 1 + i])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]
