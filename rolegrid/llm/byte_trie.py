"""Context trie over bytes as sorted arrays, and prediction by partial matching on it.

A window is a symbol with the ``DEPTH`` symbols before it, packed into 54 bits of an integer: the nearest
symbol highest, the predicted one lowest. In sorted order the windows of every trie node of order ``k`` (the
``k`` nearest symbols) stand side by side, so a trie is a sorted array of windows with their counts.
Symbols are the 256 bytes, an end of text, and a pad that fills the context before a text's first byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEPTH, BITS = 5, 9
END, PAD, ALPHABET = 256, 257, 257
LOW = (1 << BITS) - 1
SLICE = 1 << 20


def windows(bodies: list[bytes], part: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, places in ``bodies``, their number of windows) for every byte and end, in slices of about
    ``part`` windows: a giant text goes through several slices, many short ones share one."""
    held: list[np.ndarray] = []
    places: list[int] = []
    sizes: list[int] = []
    filled = 0

    def flush():
        a = np.concatenate(held)
        out = a[DEPTH:].astype(np.int64)
        for k in range(1, DEPTH + 1):
            out |= a[DEPTH - k : len(a) - k].astype(np.int64) << (BITS * (DEPTH + 1 - k))
        # The windows that would start in one piece and end in the next one's context are not windows of a text.
        real = np.concatenate([np.r_[np.zeros(DEPTH, bool), np.ones(n, bool)] for n in sizes])[DEPTH:]
        return out[real], np.array(places), np.array(sizes)

    for place, body in enumerate(bodies):
        raw = np.frombuffer(body, np.uint8)
        for at in range(0, len(body) + 1, part):
            piece = raw[at : at + part].astype(np.int16)
            if at + part > len(body):
                piece = np.r_[piece, np.int16(END)]
            context = raw[max(0, at - DEPTH) : at].astype(np.int16)
            held.append(np.r_[np.full(DEPTH - len(context), PAD, np.int16), context, piece])
            places.append(place)
            sizes.append(len(piece))
            filled += len(piece)
            if filled >= part:
                yield flush()
                held, places, sizes, filled = [], [], [], 0
    if held:
        yield flush()


def add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys.astype(np.int64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def shorten(keys: np.ndarray, order: int) -> np.ndarray:
    """Windows cut to the ``order`` nearest context symbols."""
    return ((keys >> (BITS * (DEPTH + 1 - order))) << BITS) | (keys & LOW)


def find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked keys in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return at, table[at] == asked


class Level:
    """The nodes of one order: (context, symbol) entries with counts, and per context the sum, the number of
    distinct symbols, and ``shadow``: the sum that its symbols have at the next shorter context."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, parent: Level | None):
        self.entries, self.counts = entries, counts
        contexts = entries >> BITS
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(entries) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.sums = np.add.reduceat(counts, first) if len(entries) else counts
        self.distinct = np.diff(np.r_[first, len(entries)])
        self.shadow = np.zeros(len(first), np.int64)
        if parent is not None and len(entries):
            # A parent's context drops the farthest symbol, which stands lowest; it has every symbol of its child.
            at, _ = find(parent.entries, ((contexts >> BITS) << BITS) | (entries & LOW))
            self.shadow = np.add.reduceat(parent.counts[at], first)


def levels(keys: np.ndarray, counts: np.ndarray, shared: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The trie of sorted windows, order 0 first. ``shared`` gives the entries of the lowest orders over all
    windows, where ``keys`` are only a part of them (whole contexts of order ``len(shared)``)."""
    out: list[Level] = []
    for order in range(DEPTH + 1):
        entries, n = shared[order] if order < len(shared) else add(shorten(keys, order), counts)
        out.append(Level(entries, n, out[-1] if out else None))
    return out


def log_probability(trie: list[Level], asked: np.ndarray) -> np.ndarray:
    """log10 of the probability of each asked window's symbol after its context.

    Escape as in method C: a node that has ``q`` distinct symbols left keeps ``q / (sum + q)`` for others.
    Symbols of the longer context are excluded from a shorter one's sum and ``q``; a node with none left is
    passed over, one that leaves no other symbol keeps nothing, and below order 0 the rest is uniform. The
    probabilities of the 257 symbols after a context add up to 1.
    """
    out = np.zeros(len(asked))
    open_ = np.arange(len(asked))
    shadow, used = np.zeros(len(asked)), np.zeros(len(asked))  # of the longer context, as seen from here
    for order in range(DEPTH, -1, -1):
        level, key = trie[order], shorten(asked[open_], order)
        node, there = find(level.contexts, key >> BITS)
        entry, hit = find(level.entries, key)
        if not len(level.contexts):
            continue
        left, q = level.sums[node] - shadow[open_], level.distinct[node] - used[open_]
        kept = np.where(level.distinct[node] < ALPHABET, q, 0)
        live = there & (q > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            taken = np.log10(np.where(hit, level.counts[entry], 1) / (left + kept))
            passed = np.log10(kept / (left + kept))
        out[open_] += np.where(live, np.where(hit, taken, passed), 0.0)
        shadow[open_], used[open_] = np.where(there, level.shadow[node], shadow[open_]), np.where(there, level.distinct[node], used[open_])
        open_ = open_[~(live & hit)]
    out[open_] -= np.log10(ALPHABET - used[open_])
    return out


class Lookup:
    """Values by integer key through open addressing, a few array passes for millions of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            slot, left = (slot[~placed] + 1) & (len(self.keys) - 1), left[~placed]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """Values of asked keys; every one of them has to be there."""
        out, slot, left = np.zeros(len(asked)), self.slots(asked), None
        hit = self.keys[slot] == asked
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            if (self.keys[slot] == -1).any():
                raise KeyError("a window without an answer")
            hit = self.keys[slot] == asked[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out
