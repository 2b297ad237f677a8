"""A minimal perfect hash over 64-bit keys in numpy: levels of bit arrays in which a key owns
the bit it alone hits; keys that collide go on to the next level. A key's index is the number
of set bits before its own."""

from __future__ import annotations

import numpy as np

from .common import mix64

GAMMA, LEVELS = 1.6, 48


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes in 64-bit words and the concatenated words, for distinct keys (uint64)."""
    sizes, words, left = [], [], np.asarray(keys, np.uint64)
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys of a perfect hash must be distinct")
        n = max(1, int(np.ceil(GAMMA * len(left) / 64)))
        at = (mix64(left, len(sizes)) % np.uint64(n * 64)).astype(np.int64)
        hit = np.bincount(at, minlength=n * 64)
        words.append(np.packbits(hit == 1, bitorder="little").view(np.uint64))
        sizes.append(n)
        left = left[hit[at] > 1]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; -1 where no level holds its bit. Keys that were not built in may
        get any index, so callers compare the fingerprint stored there."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes):
            if not len(open_):
                break
            at = mix64(keys[open_], level) % np.uint64(n * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[found], bit[found]
            below = self.words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[open_[found]] = self.before[w] + np.bitwise_count(below)
            open_, base = open_[~found], base + n
        return out
