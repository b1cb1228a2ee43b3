"""Sets of word shingles as sorted 64-bit hashes.

A word is what white space parts, lower-cased and without characters that are neither letters nor digits; pieces
without any are no words. A text of fewer words than a shingle has one shingle of all its words; a text without
words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np

from stintlab.llm.common import kept

SIZE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A worker's memory of words: their number, and the length of the longest.
_MAX_MEMO, _MAX_KEPT_CHARS = 300_000, 100


class _Hashes(dict):
    """From a raw piece of text to its word's hash; 0 for no word."""

    def __missing__(self, raw: str) -> int:
        word = raw.lower()
        if not word.isalnum():
            word = "".join(filter(str.isalnum, word))
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1 if word else 0
        if len(raw) <= _MAX_KEPT_CHARS:
            if len(self) >= _MAX_MEMO:
                self.clear()
            self[raw] = code
        return code


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = (text or "").split()
    words = np.fromiter(map(kept("word hashes", _Hashes).__getitem__, raw), np.uint64, len(raw))
    words = words[words != 0]
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * _MULTIPLIER + words[k : k + len(out)])
    return np.unique(out)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
