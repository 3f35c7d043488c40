"""Words of a text as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a run of words; made from a fixed seed.
_PLACES = np.random.default_rng(20240229).integers(0, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordCache(dict):
    """Hash of each word of LONGEST bytes at most; emptied when it holds `most` words, so its memory is bounded."""

    LONGEST = 64

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at exactly these six characters, bytes.lower() maps A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of `width` words, by start; empty with fewer words. Lanes are independent hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    places = _PLACES[lane * width : (lane + 1) * width]
    out = hashes[:n] * places[0]
    for j in range(1, width):
        out += hashes[j : n + j] * places[j]
    return mix(out)
