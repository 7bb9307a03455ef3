"""FM-index over word numbers: a wavelet matrix with packed bits and block counts."""

from __future__ import annotations

import numpy as np

from segmill.llm.suffix_array import _number


def sorted_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """All suffixes sorted by their first ``length`` symbols, ties by place."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n + length, np.int64)
    _number(rank, order, symbols[order])
    rank[:n] += 1  # 0 is behind the end
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        key = (rank[:n].astype(np.uint64) << np.uint64(32)) | rank[step : n + step].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        _number(rank, order, key[order])
        rank[:n] += 1
    return order


class WaveletMatrix:
    """Counts of a symbol before a place; one row of packed bits per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(symbols)
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where a place, seen as a border, goes when its symbol's bits are followed down."""
        for level in range(self.levels):
            block, inside = place >> 6, (place & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.before[level][block] + np.bitwise_count(self.bits[level][block] & mask)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return place


class FMIndex:
    """Backward search over a sequence of symbols 1 .. sigma; 0 separates its parts.

    Suffixes are sorted by ``length`` symbols, which is enough for patterns up to
    that length.
    """

    def __init__(self, symbols: np.ndarray, length: int):
        self.suffixes = sorted_suffixes(symbols, length)
        sigma = int(symbols.max(initial=0)) + 1
        transformed = symbols[self.suffixes - 1]
        self.matrix = WaveletMatrix(transformed, max(1, int(sigma).bit_length()))
        counts = np.bincount(symbols, minlength=sigma)
        self.start = np.cumsum(counts) - counts
        self.end = np.cumsum(counts)
        every = np.arange(sigma)
        self.base = self.matrix.follow(every, np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of the patterns that begin one symbol earlier."""
        both = self.matrix.follow(np.r_[symbol, symbol], np.r_[low, high])
        shift = self.start[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift


def matching(index: FMIndex, symbols: np.ndarray, ends: np.ndarray, length: int):
    """Matching statistics of the places before ``ends``, counted up to ``length``.

    Returns how many symbols before each end occur at least twice in the index, and
    the interval of those that reach ``length``. A search stops where it has one
    occurrence left, its own.
    """
    matched = np.zeros(len(ends), np.int64)
    low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    some = np.arange(len(ends))
    last = symbols[ends - 1]
    a, b = index.start[last], index.end[last]
    for t in range(length):
        if t:
            a, b = index.extend(symbols[ends[some] - 1 - t], a, b)
        more = b - a >= 2
        some, a, b = some[more], a[more], b[more]
        matched[some] = t + 1
    low[some], high[some] = a, b
    return matched, low, high
