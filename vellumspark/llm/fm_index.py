"""An FM-index over integer symbols: wavelet-tree ranks, sampled positions.

Symbol 0 separates independent runs; nothing matches across it.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; a suffix ends at its separator.

    Separators differ from each other (by position), so equal runs are ordered
    by what ends them.  Each round sorts only the suffixes that are still tied.
    """
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_rank[1:] != sorted_rank[:-1]
    # The rank of a group is the place of its first member.
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    step = 1
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        members = order[places]
        after = members + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        major = rank[members]
        by = np.lexsort((second, major))
        members, major, second = members[by], major[by], second[by]
        order[places] = members
        new = np.ones(len(places), bool)
        new[1:] = (major[1:] != major[:-1]) | (second[1:] != second[:-1])
        fresh[places] = new
        lead = np.maximum.accumulate(np.where(new, places, 0))
        rank[members] = lead
        step *= 2


class BitRanks:
    """A bit vector with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        words = np.zeros((n >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    SAMPLE = 16

    def __init__(self, symbols: np.ndarray):
        """``symbols`` ends with 0."""
        n = self.size = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1]  # of position 0: the separator at the end
        kinds = int(symbols.max(initial=0)) + 1
        self.first = np.zeros(kinds + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=kinds), out=self.first[1:])
        self.levels: list[tuple[int, BitRanks, int]] = []
        level = last.astype(np.int64)
        for bit in reversed(range(max(1, (kinds - 1).bit_length()))):
            ones = (level >> bit) & 1 == 1
            self.levels.append((bit, BitRanks(ones), int(n - ones.sum())))
            level = np.concatenate([level[~ones], level[ones]])
        # Positions are kept for every SAMPLE-th place and where a run begins.
        kept = (order % self.SAMPLE == 0) | (last == 0)
        self.kept = BitRanks(kept)
        self.places = order[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks.ones(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at`` in the transformed text."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each row of ``patterns``."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[:, column].astype(np.int64)
            known = symbol < len(self.first) - 1
            symbol = np.where(known, symbol, 0)
            base = self._down(symbol, np.zeros_like(low))
            low = np.where(known, self.first[symbol] + self._down(symbol, low) - base, 0)
            high = np.where(known, self.first[symbol] + self._down(symbol, high) - base, 0)
            high = np.maximum(high, low)
        return low, high

    def _step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one place further left."""
        at, symbol = rows, np.zeros_like(rows)
        for bit, ranks, zeros in self.levels:
            one, ones = ranks.get(at), ranks.ones(at)
            symbol = symbol | (one.astype(np.int64) << bit)
            at = np.where(one, zeros + ones, at - ones)
        return self.first[symbol] + at - self._down(symbol, np.zeros_like(at))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found = np.full(len(rows), -1, np.int64)
        open_, current, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            kept = self.kept.get(current)
            found[open_[kept]] = self.places[self.kept.ones(current[kept])] + steps
            open_, current = open_[~kept], current[~kept]
            if len(open_):
                current = self._step(current)
            steps += 1
        return found
