"""Sets of word shingles as stable 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Odd multipliers (fixed values): one per place in a shingle, and one to mix.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class Hashes(dict):
    """64-bit hashes of words, computed on first use; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_hashes = Hashes()


def forget() -> None:
    """Empty the table of words; a worker lives on after its task."""
    _hashes.clear()


def shingle_set(text: bytes, width: int = 3) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: A-Z lower-cased, words between white space; a text with
    fewer words than ``width`` is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += mix(h[k : n + k]) * PLACE[k]
    return np.unique(mix(out + np.uint64(width)))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of the set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
