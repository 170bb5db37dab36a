"""A minimal perfect hash over 64-bit keys in numpy.

Each level marks the slots that exactly one of the keys left over hits; keys that collide go to the next
level. A key's number is the rank of its slot among all marked slots, so n keys get the numbers 0..n-1.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys + np.uint64(_ODD * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x ^= x >> np.uint64(27)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """levels: one bit array per level, kept as packed bytes with their sizes in bits."""

    def __init__(self, sizes: list[int], packed: list[bytes]):
        self.sizes = sizes
        self.packed = packed
        self._bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=s).astype(bool) for s, p in zip(sizes, packed)]
        self._rank, below = [], 0
        for bits in self._bits:
            ranks = np.cumsum(bits, dtype=np.int64) - 1 + below
            self._rank.append(ranks)
            below += int(bits.sum())
        self.n = below

    @classmethod
    def build(cls, keys: np.ndarray, spare: float = 1.6) -> PerfectHash:
        """keys: distinct 64-bit unsigned integers."""
        sizes, packed, left, level = [], [], keys, 0
        while len(left):
            size = max(64, int(len(left) * spare))
            at = _slots(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            packed.append(np.packbits(alone).tobytes())
            left = left[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("the keys are not distinct")
        return cls(sizes, packed)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key. A key outside the set gets any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _slots(keys[open_], level, size)
            hit = self._bits[level][at]
            found[open_[hit]] = self._rank[level][at[hit]]
            open_ = open_[~hit]
        return found
