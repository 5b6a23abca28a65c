"""Hashed word shingles, computed in batches on the workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
WIDTH = 5
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """Hash of a word; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hash_of = _Hashes().__getitem__


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[str]:
    """Words of a whole text: runs of letters, digits and underscores, in lower case."""
    return WORD.findall((text or "").lower())


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in text order. A text with fewer words has one shingle, a text without any none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    if len(hashes) < width:
        total = np.uint64(len(hashes))
        for at, value in enumerate(hashes):
            total = mix(np.array([total ^ value], np.uint64) * _WEIGHTS[at])[0]
        return np.array([total], np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for at in range(width):
        total += hashes[at:len(hashes) - width + 1 + at] * _WEIGHTS[at % len(_WEIGHTS)]
    return mix(total)
