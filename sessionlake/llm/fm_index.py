"""FM-index over a sequence of integers: wavelet-tree ranks and a sampled suffix array.

Everything is vectorised over many phrases at once; an index holds one shard, whose
size its maker bounds.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector with constant-time counts of set bits before a position."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 64 + 1
        padded = np.zeros(blocks * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.blocks).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.total = int(counts.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64) & _ONE).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[at >> 6] + np.bitwise_count(self.blocks[at >> 6] & below)


class WaveletTree:
    """Levelwise wavelet tree: at each level zeros go left and ones right, stably."""

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for bit in reversed(range(self.depth)):
            ones = (sequence >> bit & 1).astype(bool)
            self.levels.append((Bits(ones), len(sequence) - int(ones.sum())))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, high = np.zeros_like(at), at
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            before_low, before_high = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + before_low, low - before_low)
            high = np.where(one, zeros + before_high, high - before_high)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for bits, zeros in self.levels:
            one = bits.get(at)
            before_low, before_at = bits.rank(low), bits.rank(at)
            symbol = symbol << 1 | one
            low = np.where(one, zeros + before_low, low - before_low)
            at = np.where(one, zeros + before_at, at - before_at)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length compared; ``text`` has one last 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(in_order[1:] != in_order[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of ``text``, integers from 1; a 0 is put behind it."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], alphabet)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        marked = order % sample == 0
        self.marks, self.samples = Bits(marked), order[marked]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases (one a row, same lengths), from their ends back."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        for place in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, place]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(phrases), dtype=bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one is met."""
        steps, positions = np.zeros_like(rows), np.zeros_like(rows)
        walking, at = np.arange(len(rows)), rows.copy()
        while len(walking):
            done = self.marks.get(at)
            positions[walking[done]] = self.samples[self.marks.rank(at[done])]
            walking, at = walking[~done], at[~done]
            symbol, before = self.tree.symbol_and_rank(at)
            at = self.first[symbol] + before
            steps[walking] += 1
        return positions + steps

    def occurrences(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and text position of every occurrence."""
        low, high = self.search(phrases)
        counts = high - low
        phrase = np.repeat(np.arange(len(phrases)), counts)
        firsts = np.cumsum(counts) - counts
        rows = np.arange(counts.sum()) - np.repeat(firsts, counts) + np.repeat(low, counts)
        return phrase, self.locate(rows)
