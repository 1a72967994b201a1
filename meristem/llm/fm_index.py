"""FM-index over integer texts: suffix array by prefix doubling, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol in any prefix, one packed bit plane for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = n = len(symbols)
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.planes.append((words, counts, int(n - bit.sum())))
            current = np.concatenate([current[~bit], current[bit]])

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray, int], i: np.ndarray) -> np.ndarray:
        words, counts, _ = plane
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(words[block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``i`` (both arrays)."""
        lo = np.zeros(len(i), np.int64)
        hi = i.astype(np.int64)
        for k, plane in enumerate(self.planes):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo1, hi1 = self._ones(plane, lo), self._ones(plane, hi)
            lo = np.where(one, plane[2] + lo1, lo - lo1)
            hi = np.where(one, plane[2] + hi1, hi - hi1)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position ``i`` and how often it occurs before ``i``."""
        lo = np.zeros(len(i), np.int64)
        at = i.astype(np.int64)
        symbol = np.zeros(len(i), np.int64)
        for plane in self.planes:
            lo1, at1 = self._ones(plane, lo), self._ones(plane, at)
            one = ((plane[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol = (symbol << 1) | one
            lo = np.where(one, plane[2] + lo1, lo - lo1)
            at = np.where(one, plane[2] + at1, at - at1)
        return symbol, at - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is a separator of its own, smaller than those after it.

    Suffixes differ no later than at their first separator, so doubling ends with the longest repeated run. Each
    round sorts only suffixes that are still tied.
    """
    n = len(text)
    first = text.astype(np.int64)
    separators = np.flatnonzero(first == 0)
    key = first + len(separators)
    key[separators] = np.arange(len(separators))
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[sa] = group
    k = 1
    while not fresh.all():
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)
        sub = sa[slots]
        key1, key2 = rank[sub], rank[np.minimum(sub + k, n)]
        order = np.lexsort((key2, key1))
        sub, key1, key2 = sub[order], key1[order], key2[order]
        sa[slots] = sub
        new = np.ones(len(sub), bool)
        new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
        fresh[slots] = new
        rank[sub] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2
    return sa


class FMIndex:
    """Backward search and location over a text of symbols 0 .. sigma-1, where 0 separates runs."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(text.astype(np.int64), 0)
        self.n = n = len(text)
        self.sigma = sigma
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.tree = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        # Positions that a walk to the left may not cross are sampled too: those after a separator.
        kept = (sa % sample == 0) | (bwt == 0)
        self.sampled = WaveletMatrix(kept.astype(np.int64), 2)
        self.positions = sa[kept].astype(np.int64)
        self.size = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns (rows, right-aligned: the last symbol stands in the last column)."""
        q, width = patterns.shape
        lo, hi = np.zeros(q, np.int64), np.full(q, self.n, np.int64)
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk to the left until a sampled row."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            flag, ones = self.sampled.access_rank(at[left])
            done = flag == 1
            out[left[done]] = self.positions[ones[done]] + steps[left[done]]
            left = left[~done]
            if len(left):
                symbol, r = self.tree.access_rank(at[left])
                at[left] = self.before[symbol] + r
                steps[left] += 1
        return out
