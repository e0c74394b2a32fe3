"""A compressed full-text index over integer symbols, searched for many patterns at a time.

The Burrows-Wheeler transform of the text is held in a wavelet tree whose codes are as long as
the symbols are rare, so it takes about the entropy of the text. A backward-search step for a
whole array of patterns is a handful of vector operations for each level of the tree.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all rotations of ``text``, which holds one symbol that occurs once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    def __init__(self, text: np.ndarray, n_symbols: int):
        n = max(1, len(text))
        freq = np.maximum(np.bincount(text, minlength=n_symbols), 1)
        # Shannon code lengths satisfy Kraft's inequality; codes are dealt in the order of length
        length = np.maximum(1, np.ceil(np.log2((n + n_symbols) / freq)).astype(np.int64))
        deepest = int(length.max())
        order = np.argsort(length, kind="stable")
        width = np.int64(1) << (deepest - length[order])
        code = np.zeros(n_symbols, np.int64)
        code[order] = np.cumsum(width) - width
        self.length, self.bit, self.start, self.levels = length, [], [], []
        left = text
        for level in range(deepest):
            bit = ((code >> (deepest - 1 - level)) & 1).astype(np.uint8)
            prefix = code >> (deepest - level)
            own = prefix[left]
            begins = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.zeros(0, np.int64)
            at = np.argsort(own[begins])
            nodes = own[begins][at]
            place = np.minimum(np.searchsorted(nodes, prefix), max(0, len(nodes) - 1))
            self.start.append(begins[at][place].astype(np.int32) if len(nodes) else np.zeros(n_symbols, np.int32))
            bits = bit[left]
            self.levels.append(_Bits(bits))
            self.bit.append(bit)
            going = length[left] > level + 1
            left = np.concatenate([left[(bits == 0) & going], left[(bits == 1) & going]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        at = at.astype(np.int64)
        active = np.arange(len(symbols))
        for level in range(len(self.levels)):
            if not len(active):
                break
            s = symbols[active]
            start = self.start[level][s].astype(np.int64)
            i = at[active]
            ones = self.levels[level].ones(start + i) - self.levels[level].ones(start)
            at[active] = np.where(self.bit[level][s] == 1, ones, i - ones)
            active = active[self.length[s] > level + 1]
        return at


class FmIndex:
    """Index over dense symbols from 1 on; ``labels`` gives each place of the text a value, of which intervals yield the least."""

    def __init__(self, text: np.ndarray, labels: np.ndarray, n_symbols: int):
        text = np.append(text, 0)  # occurs once and is the least
        order = suffix_order(text)
        self.labels = np.append(labels, np.iinfo(np.int64).max)[order]
        self.before = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.before[1:])
        self.tree = WaveletTree(text[order - 1], n_symbols)

    def matching_statistics(self, words: np.ndarray, ends: np.ndarray, threshold: int, lone: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of ``ends`` in ``words``: the length of the longest match that ends there (up to ``threshold``) and its interval.

        With ``lone`` false, a match counts only while it occurs twice or more: in a search for the text's own parts, the one occurrence is the part itself.
        """
        least = 1 if lone else 2
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.before[-1])
        active = np.arange(len(ends))
        for back in range(threshold):
            c = words[ends[active] - back]
            if back == 0:
                lo, hi = self.before[c], self.before[c + 1]
            else:
                both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[active], high[active]]))
                lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            found = hi - lo >= least
            active = active[found]
            low[active], high[active] = lo[found], hi[found]
            length[active] = back + 1
            if not len(active):
                break
        return length, low, high

    def least_label(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least label of each interval; intervals of one depth are equal or apart."""
        if not len(low):
            return np.zeros(0, np.int64)
        lows, first, of = np.unique(low, return_index=True, return_inverse=True)
        edges = np.empty(2 * len(lows), np.int64)
        edges[0::2], edges[1::2] = lows, high[first]
        if edges[-1] == len(self.labels):
            edges = edges[:-1]
        return np.minimum.reduceat(self.labels, edges)[0::2][of]
