"""A compressed FM-index over integer sequences, in numpy.

The Burrows-Wheeler transform is kept as a wavelet matrix: one packed bit vector per
bit of the alphabet, with running counts every 64 bits.  Suffixes are sorted as deep
as matches are followed, which is all that backward search needs.
"""

from __future__ import annotations

import numpy as np

WORD = 64


class Bits:
    """A bit vector with rank."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // WORD + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for b in range(self.bits - 1, -1, -1):
            one = ((symbols >> b) & 1).astype(bool)
            self.levels.append(Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        # Where each symbol's run begins on the last level.
        self.first = np.searchsorted(_reversed(symbols, self.bits), _reversed(np.arange(alphabet), self.bits)) \
            if alphabet > 1 else np.zeros(alphabet, np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - depth)) & 1
            ones = level.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i - self.first[symbol]


def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
    """x with its lowest ``bits`` bits in reverse order; a wavelet matrix ends sorted by it."""
    out = np.zeros_like(x)
    for b in range(bits):
        out |= ((x >> b) & 1) << (bits - 1 - b)
    return out


class FMIndex:
    """Finds, for sequences of the index, where each run of ``length`` symbols also stands.

    values: one number per sequence; a run's answer is the smallest value of the
    sequences that hold it.
    """

    def __init__(self, sequences: list[np.ndarray], values: np.ndarray, length: int):
        self.length = length
        alphabet, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
        self.sizes = np.array([len(s) for s in sequences])
        self.ends = np.cumsum(self.sizes + 1) - 1  # places of the separators, symbol 0
        text = np.zeros(len(symbols) + len(sequences), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = symbols + 1
        order, same = self._sorted(text)
        bwt = text[order - 1]
        self.wavelet = Wavelet(bwt, len(alphabet) + 1)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(alphabet) + 1))])
        # Rows that agree in their first ``length`` symbols form a group.
        self.group_bits = Bits(~same)
        self.group_at = np.append(np.flatnonzero(~same), len(text))
        owner = np.repeat(np.arange(len(sequences)), self.sizes + 1)
        self.group_value = np.minimum.reduceat(values[owner[order]], self.group_at[:-1])
        self.text = text.astype(np.int32)

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of the ``length`` + 1 symbols that follow; and which agree in ``length`` with the one before."""
        n = len(text)
        rank, depth, ranks = text, 1, {}
        place = np.arange(n)
        while True:
            ranks[depth] = rank
            if depth > self.length:
                break
            key = rank * (n + 1) + rank[(place + depth) % n]
            _, rank = np.unique(key, return_inverse=True)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        same, at = np.ones(n, bool), 0
        for d in sorted(ranks, reverse=True):
            if at + d <= self.length:
                r = ranks[d][(order + at) % n]
                same[1:] &= r[1:] == r[:-1]
                at += d
        same[0] = False
        return order, same

    def group(self, row: np.ndarray) -> np.ndarray:
        return self.group_bits.rank(row + 1) - 1

    def smallest(self) -> list[np.ndarray]:
        """Per sequence, the answer of each of its runs of ``length`` symbols, by backward search.

        All sequences are streamed side by side, each from its end.  A match grows by one symbol a step; at
        ``length`` + 1 it drops its last one, which widens its rows to the group they are in.
        """
        out = [np.empty(max(0, n - self.length + 1), np.int64) for n in self.sizes]
        flat = np.concatenate([*out, np.empty(0, np.int64)])
        first = np.concatenate([[0], np.cumsum([len(o) for o in out])])
        live = np.argsort(-self.sizes, kind="stable")
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        for step in range(int(self.sizes.max(initial=0))):
            live = live[:np.searchsorted(-self.sizes[live], -step, side="left")]
            low, high = low[:len(live)], high[:len(live)]
            c = self.text[self.ends[live] - 1 - step].astype(np.int64)
            low = self.starts[c] + self.wavelet.rank(c, low)
            high = self.starts[c] + self.wavelet.rank(c, high)
            if step >= self.length - 1:
                g = self.group(low)
                low, high = self.group_at[g], self.group_at[g + 1]
                flat[first[live] + self.sizes[live] - 1 - step] = self.group_value[g]
        return np.split(flat, first[1:-1])
