"""FM-index of a sequence of symbols: wavelet-tree ranks, backward search, sampled positions.

The sequence is cut into segments by the symbol 0; no match goes across it. All steps work
on arrays of many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class Bits:
    """Packed bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((n // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks and symbols of a sequence, one level of bits for each bit of a symbol.

    Levels lie side by side in one order (the matrix form of the tree): at each, the
    symbols with bit 0 come first.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.height = max(1, int(alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        rest = symbols
        for level in reversed(range(self.height)):
            bit = (rest >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(len(rest) - self.levels[-1].ones)
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.start = self.descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.height - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self.descend(symbol, at) - self.start[symbol]

    def symbols(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            bit = bits.get(at).astype(np.int64)
            ones = bits.rank(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = out << 1 | bit
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by the suffix that begins there; each 0 differs from the others, by position."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        # The ranks of a round are below n + alphabet, so a pair fits in 64 bits.
        key = rank * (int(max(rank.max(), after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[-1] == n - 1 or step >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


class FMIndex:
    """``text``: symbols from 1 to ``alphabet`` - 1, each segment followed by a 0."""

    def __init__(self, text: np.ndarray, alphabet: int):
        order = suffix_order(text)
        before = text[order - 1]
        self.size = len(text)
        self.tree = WaveletTree(before.astype(np.int64), alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.less = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # A walk ends at a segment's start at the latest.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.positions = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row) the range of index rows that begin with it."""
        found = np.arange(len(patterns))
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[found, k]
            low[found] = self.less[symbol] + self.tree.rank(symbol, low[found])
            high[found] = self.less[symbol] + self.tree.rank(symbol, high[found])
            found = found[low[found] < high[found]]
        gone = np.ones(len(patterns), bool)
        gone[found] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by walking back to the nearest kept one."""
        out = np.empty(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            known = self.kept.get(at) == 1
            done = open_[known]
            out[done] = self.positions[self.kept.rank(at[known])] + steps
            open_ = open_[~known]
            at = at[~known]
            symbol = self.tree.symbols(at)
            rows[open_] = self.less[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
