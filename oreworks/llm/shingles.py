"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of a word, remembered up to `limit` words; then it starts anew."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's `words`-word runs; a shorter text is one run, one without words has none.

    A-Z are lower-cased; words are what white space (blank, and 9 to 13) separates.
    """
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(each))
    runs = each[: len(each) - width + 1].copy()
    for k in range(1, width):
        runs = runs * _STEP + each[k : len(each) - width + 1 + k]
    runs ^= runs >> np.uint64(32)
    runs *= _SPREAD
    runs ^= runs >> np.uint64(29)
    return np.unique(runs)
