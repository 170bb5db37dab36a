"""A run-length index of a byte string in numpy: the Burrows-Wheeler transform as runs, with samples at run ends.

At each boundary between two runs the suffixes on both sides are sampled with the length of their common prefix.
All other lengths follow: a suffix whose preceding byte equals that of its neighbour in suffix order has a match one
shorter than the suffix before it in the text. So the longest match of every suffix with any other (its matching
statistic against the rest of the text) is streamed in text order from one sample per run end.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes: sort by the first eight bytes, then double the sorted length for ties only."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    del key
    index = np.arange(n)
    start = np.maximum.accumulate(np.where(first, index, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    at = np.flatnonzero(~first | ~np.append(first[1:], True))  # places in order that are not settled
    step = 8
    while len(at):
        suffix = order[at]
        ahead = suffix + step
        # A suffix that has ended is smaller than any that goes on, and the shorter of two ended ones is.
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1 - suffix)
        both = rank[suffix] * np.int64(2 * n + 1) + second + n
        by = np.argsort(both, kind="stable")
        suffix, both = suffix[by], both[by]
        order[at] = suffix
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b (a and b differ elementwise)."""
    n = len(text)
    words = np.concatenate([text, np.zeros(16, np.uint8)])
    wide = np.ndarray((n + 8,), "<u8", buffer=words, strides=(1,))
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    while len(open_):
        differ = wide[np.minimum(x, n)] ^ wide[np.minimum(y, n)]
        room = n - np.maximum(x, y)
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, np.maximum(room, 0))
        out[open_] += same
        go = (same == 8) & (room > 8)
        open_, x, y = open_[go], x[go] + 8, y[go] + 8
    return out


class RunIndex:
    """symbols and lengths: the runs. before, after: (text position, match length) samples at run starts and ends."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        order = suffix_order(text) if n else np.zeros(0, np.int64)
        last = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))  # -1 stands before the first byte
        edge = np.flatnonzero(last[1:] != last[:-1]) + 1
        starts = np.concatenate([[0], edge]) if n else edge
        self.symbols = last[starts]
        self.lengths = np.diff(np.append(starts, n))
        match = common_prefixes(text, order[edge - 1], order[edge])
        if n:
            self.before = np.append(order[edge], order[0]), np.append(match, 0)
            self.after = np.append(order[edge - 1], order[-1]), np.append(match, 0)

    def _stream(self, sample: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, length = sample
        reach = np.full(self.n, -1, np.int64)
        reach[at] = at + length  # a match of that length at that place ends here
        held = np.zeros(self.n, bool)
        held[at] = True
        last = np.maximum.accumulate(np.where(held, np.arange(self.n), -1))
        return np.where(last >= 0, reach[np.maximum(last, 0)], 0) - np.arange(self.n)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts anywhere else."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.maximum(np.maximum(self._stream(self.before), self._stream(self.after)), 0)
