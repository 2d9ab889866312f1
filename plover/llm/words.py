"""Words, word hashes and shingle sets of whole texts, in numpy.

These helpers run inside tasks, one text at a time; memory is bounded by the
longest text and by `WordHashes.most`.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the polynomial over word hashes and of the final mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes by word, remembered for up to ``most`` words."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of each 64-bit value over all of its bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def ngrams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= BASE
        out += hashes[k : n + k]
    return mixed(out)


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle; no words, none."""
    if not len(hashes):
        return hashes
    return np.unique(ngrams(hashes, min(width, len(hashes))) + np.uint64(min(width, len(hashes))))


_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Words as `plain_words`, with ASCII punctuation taken as white space too."""
    return text.encode("utf-8", "replace").translate(_LETTERS).lower().split() if text else []
