"""Minimal perfect hash over distinct 64-bit keys: cascaded bit arrays with ranks, built and probed by whole arrays."""

from __future__ import annotations

import numpy as np

GAMMA = 2.0  # bits of a level for each key that comes to it


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each key, another one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct keys from 0 to n-1. Any other key gets -1 or the number of some key: compare a fingerprint."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, n: int):
        self.sizes, self.words, self.ranks, self.n = sizes, words, ranks, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Each level takes the keys that no other meets at their place in it; those that meet go on to the next."""
        keys, sizes, words = np.asarray(keys, np.uint64), [], []
        n = len(keys)
        while len(keys):
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
            size = max(64, int(len(keys) * GAMMA + 63) // 64 * 64)
            at = mix(keys, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        counts = np.bitwise_count(flat).astype(np.int64)
        return cls(sizes, flat, (np.cumsum(counts) - counts).astype(np.uint32), n)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) != 0
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[word].astype(np.int64) + below)[hit]
            left, base = left[~hit], base + size // 64
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"mph_sizes": np.array(self.sizes, np.int64), "mph_words": self.words, "mph_ranks": self.ranks, "mph_n": np.array([self.n], np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> PerfectHash:
        return cls(arrays["mph_sizes"].tolist(), arrays["mph_words"], arrays["mph_ranks"], int(arrays["mph_n"][0]))
