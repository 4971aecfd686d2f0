"""FM-index of a sequence of numbers: a wavelet matrix over its transform, searched backwards in bulk."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask).astype(np.int32)


class FMIndex:
    """Finds all patterns of up to ``depth`` symbols; suffixes are sorted by their first ``depth`` symbols or more.

    Symbols are 0 .. ``symbols`` - 1. Two suffixes alike in so many symbols stand in order of position, which
    leaves the rows of every pattern of up to ``depth`` symbols next to each other.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int = 16):
        rank = text.astype(np.int64)
        length = 1
        while length < depth:
            tail = np.zeros(len(rank), np.int64)
            tail[:-length] = rank[length:] + 1
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + tail, return_inverse=True)[1]
            length *= 2
        self.depth = length
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        row = text[self.suffixes - 1].astype(np.int32)  # the symbol before each suffix, the last one before the first
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols))).astype(np.int32)
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        every = np.arange(symbols, dtype=np.int32)
        self.base = self._descend(every, np.zeros(symbols, np.int32)) - self.first[:-1]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i is after all levels, on the way of its symbol."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals after putting a symbol before each pattern."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.base[symbol]
        return both[:len(low)] - base, both[len(low):] - base

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the windows ``text[start:start + length]`` that occur twice or more: numbers, low and high rows.

        A window whose interval has come down to a single row is its own only match and leaves the search.
        """
        if length > self.depth:
            raise ValueError(f"the index sorts {self.depth} symbols, a pattern has {length}")
        which = np.arange(len(starts))
        last = text[starts + length - 1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(length - 2, -1, -1):
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
            low, high = self.step(text[starts[which] + k], low, high)
        more = high - low > 1
        return which[more], low[more], high[more]
