"""A compressed full-text index over sequences of integers: a wavelet matrix over the Burrows-Wheeler transform, in numpy.

Suffixes are sorted by doubling the sorted depth until it covers a window, which is enough for backward search of patterns up to
that length. Queries run in lock step: one backward step for all of them is a few array operations a level.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit vectors from the highest bit down, each with counts of ones before every 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.bits = max(1, int(size - 1).bit_length())
        n = len(symbols)
        for level in range(self.bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((level, words, before, n - int(ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` lands in the order of the last level, following each symbol's bits."""
        at = at.astype(np.int64)
        for level, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Of a text of symbols 0 (between sequences) to size - 1; `value` has a number for each place of the text."""

    def __init__(self, text: np.ndarray, size: int, value: np.ndarray, window: int):
        if window < 2:
            raise ValueError("a window has two symbols or more")
        n = len(text)
        # half <= window - 1 and window <= 2 half, so that ranks at depth half tell prefixes of both lengths apart
        half_depth = 1 << ((window - 1).bit_length() - 1)
        rank, half, depth = text.astype(np.int32), text.astype(np.int32), 1
        order = None
        while depth < 2 * half_depth:
            after = np.zeros(n, np.int32)
            after[: n - depth] = rank[depth:]
            key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.zeros(n, np.int32)
            new[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]], dtype=np.int32)
            rank, depth = new, depth * 2
            if depth == half_depth:
                half = rank
        self.n, self.window = n, window
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, size)
        counts = np.bincount(text, minlength=size)
        every = np.arange(size)
        self.shift = np.cumsum(counts) - counts - self.wavelet.place(every, np.zeros(size, np.int64))

        def same_prefix(k: int) -> np.ndarray:
            """Whether a suffix and the one before it in order have the same first k symbols, k being window or one less."""
            far = np.zeros(n, np.int32)
            far[: n - (k - half_depth)] = half[k - half_depth :] + 1
            a, b = half[order], far[order]
            return np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]

        shorter = np.flatnonzero(~same_prefix(window - 1))
        group = np.cumsum(~same_prefix(window - 1), dtype=np.int32) - 1
        self.wide_lo = shorter[group].astype(np.int32)
        self.wide_hi = np.append(shorter[1:], n)[group].astype(np.int32)
        exact = ~same_prefix(window)
        self.group = np.cumsum(exact, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(value[order], np.flatnonzero(exact))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: the place of symbol + P, from the place of P."""
        return self.shift[symbol] + self.wavelet.place(symbol, at)

    def matches(self, query: np.ndarray, first: np.ndarray, last: np.ndarray, nothing: int) -> np.ndarray:
        """For each place of `query` whose window lies in one of the sequences [first, last): the least value among the places of
        the text where that window occurs, or `nothing`.

        Each sequence is streamed from its end. The match grows to the left by backward steps until it has the window's length;
        then its last symbol is let go, which widens the interval to that of the shorter match, and it grows on. Where a step
        finds nothing, no window over that stretch can match, and the search starts anew one symbol to the left of its end.
        """
        found = np.full(len(query), nothing, np.int64)
        end = last.astype(np.int64)
        at, lo, hi = end.copy(), np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.flatnonzero(end - self.window >= first)
        while len(live):
            symbol = query[at[live] - 1]
            both = self.step(np.r_[symbol, symbol], np.r_[lo[live], hi[live]])
            low, high = both[: len(live)], both[len(live) :]
            grew = high > low
            rows = live[grew]
            at[rows] -= 1
            lo[rows], hi[rows] = low[grew], high[grew]
            full = rows[end[rows] - at[rows] == self.window]
            found[at[full]] = self.least[self.group[lo[full]]]
            end[full] -= 1
            hi[full] = self.wide_hi[lo[full]]
            lo[full] = self.wide_lo[lo[full]]
            lost = live[~grew]
            end[lost] -= 1
            at[lost], lo[lost], hi[lost] = end[lost], 0, self.n
            live = live[end[live] - self.window >= first[live]]
        return found
