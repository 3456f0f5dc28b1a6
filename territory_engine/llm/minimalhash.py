"""Minimal perfect hashing of distinct integer keys, as arrays.

A key's place on a level is a hash of it modulo the level's size. Keys that are alone in their place
keep it, the others go to the next, smaller level. A key's index is the number of taken places before
its own, over all levels, so n keys have the indexes 0 to n - 1 and the bits of the levels are the
whole function. A key that was not among those it was built from gets some index or none: the
caller verifies it against the key stored there.
"""

from __future__ import annotations

import numpy as np

#: Places of a level for each key that is left.
ROOM = 1.6


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed unsigned 64-bit hash of integer keys (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Levels of taken places."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = np.array([int(x.sum()) for x in levels], dtype=np.int64)
        self.firsts = np.cumsum(sizes) - sizes
        self.size = int(sizes.sum())
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        """``keys`` are distinct integers from 0 on."""
        levels, left = [], keys
        while len(left):
            size = max(8, int(len(left) * ROOM))
            place = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some of the keys that it was not built from."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.arange(len(keys))
        for level, (taken, rank, first) in enumerate(zip(self.levels, self.ranks, self.firsts, strict=True)):
            if not len(at):
                break
            place = (mixed(keys[at], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[place]
            out[at[hit]] = first + rank[place[hit]]
            at = at[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        """Sizes of the levels and their bits."""
        return [len(x) for x in self.levels], np.packbits(np.concatenate([*self.levels, np.zeros(0, dtype=bool)])).tobytes()

    @classmethod
    def load(cls, sizes: list[int], bits: bytes) -> MinimalHash:
        flat = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        return cls([flat[e - s:e] for s, e in zip(sizes, ends.tolist(), strict=True)])
