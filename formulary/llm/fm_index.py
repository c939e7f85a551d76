"""A compressed FM-index over sequences of symbols, for patterns up to a fixed depth.

Suffixes are sorted by their first ``depth`` symbols, which is what backward search
for patterns up to that depth needs. The Burrows-Wheeler transform is held in a
wavelet matrix of packed bits with counts for each word of 64. All searches run
over arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << (upto & 63).astype(U64)) - U64(1)))


class WaveletMatrix:
    """Counts of a symbol in a prefix of a sequence."""

    def __init__(self, symbols: np.ndarray, number: int):
        self.height = max(1, int(number - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.height - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self.walk(np.arange(number), np.zeros(number, dtype=np.int64))

    def walk(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        for (bits, zeros), level in zip(self.levels, range(self.height - 1, -1, -1), strict=True):
            ones = bits.ones(upto)
            upto = np.where((symbol >> level) & 1, zeros + ones, upto - ones)
        return upto

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return self.walk(symbol, upto) - self.start[symbol]


def places(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    return out


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int, weights: np.ndarray):
        """text: symbols from 1, with 0 after each sequence; weights: how often each place counts."""
        n, self.depth = len(text), depth
        rank, span = places(text.astype(np.int64)), 1
        while span * 2 <= depth - 1:
            rank, span = places(self.pair(rank, span)), span * 2
        less = places(self.pair(rank, depth - 1 - span)) if span < depth - 1 else rank
        full = places(self.pair(rank, depth - span))
        suffixes = np.argsort(full, kind="stable")
        number = int(text.max()) + 1
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=number))]
        self.last = WaveletMatrix(text[suffixes - 1].astype(np.int64), number)
        # Bounds of the rows that share their first depth - 1 symbols.
        first = np.flatnonzero(np.r_[True, less[suffixes][1:] != less[suffixes][:-1]])
        group = np.cumsum(np.r_[0, less[suffixes][1:] != less[suffixes][:-1]])
        self.shorter_from, self.shorter_to = first[group], np.r_[first[1:], n][group]
        self.weight = np.r_[0, np.cumsum(weights[suffixes])]

    @staticmethod
    def pair(rank: np.ndarray, step: int) -> np.ndarray:
        """Rank of a place with that of the place ``step`` further on; past the end comes first."""
        then = np.zeros(len(rank), dtype=np.int64)
        then[: len(rank) - step] = rank[step:] + 1
        return rank * (int(rank.max()) + 2) + then

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the symbol followed by what the rows low..high have in common."""
        base = self.smaller[symbol]
        return base + self.last.rank(symbol, low), base + self.last.rank(symbol, high)

    def statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of ``text``, how often the ``depth`` symbols from there occur in the index; 0 near an end.

        The sequences run together, each from its end to its start. What is matched
        grows to ``depth`` symbols; from then on, its last one is given up (the rows
        that share one symbol less) before the next is put in front.
        """
        out = np.zeros(len(text), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        low = np.zeros(len(starts), dtype=np.int64)
        high = np.full(len(starts), len(self.shorter_from), dtype=np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            on = int(np.searchsorted(-lengths, -step, side="left"))  # sequences longer than step
            low, high = low[:on], high[:on]
            if step >= self.depth:
                low, high = self.shorter_from[low], self.shorter_to[low]
            at = starts[:on] + lengths[:on] - 1 - step
            low, high = self.extend(low, high, text[at])
            if step >= self.depth - 1:
                out[at] = self.weight[high] - self.weight[low]
        return out
