"""Recompression of word sequences: naming runs and pairs, consistently everywhere.

Every round replaces adjacent symbols by one new symbol whose name is a function
of the parts, so equal content gets equal names in any document on any machine
and no naming table has to be shuffled:

* the run round names each maximal run of one word;
* a pair round deals symbols into two classes by a bit of their names and names
  each adjacent pair (first class, second class).  Pairs can't overlap.

Whether a pair is formed depends on its two symbols alone.  So inside a window,
everything but the outermost symbols of each round is the same wherever the
window occurs: its *core*.  ``anchors`` gives every window one core symbol (the
longest, then least name) as its anchor; equal windows have equal anchors.

What a round leaves out of the core at either edge, symbol by symbol, and what is
left of the core after the last round spell a window out: two windows are equal
exactly if these symbols are.  ``keys`` names windows by them.

Every symbol has two names, from two independent hashes of the words' bytes; the
first also decides how symbols are paired.
"""

from __future__ import annotations

import numpy as np

from ._words import U, mix

ROUNDS = 5
STRONG = 4
_KA, _KB = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _range_min(key: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Least key of each [a, e), all of them non-empty and short."""
    span = e - a
    out = np.empty(len(a), U)
    table, width = key, 1
    while len(a):
        here = (span >= width) & (span < 2 * width)
        if here.any():
            i, j = a[here], e[here] - width
            out[here] = np.minimum(table[i], table[j])
        width *= 2
        if width > span.max(initial=0):
            break
        table = np.minimum(table[: len(table) - width // 2], table[width // 2 :])
    return out


class Levels:
    """The symbols of all rounds over some documents' words.

    h, g: first and second names of words; first: True at each document's first word."""

    def __init__(self, h: np.ndarray, g: np.ndarray, first: np.ndarray):
        self.h, self.g, n = h, g, len(h)
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | first[1:]
        start = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.run_start, self.run_end = start, np.append(start[1:], n)
        count = (self.run_end - start).astype(U)
        names = tuple(np.where(count > 1, mix(x[start] + count * U(0xC2B2AE3D27D4EB4F)), x[start]) for x in (h, g))
        head = first[start]
        self.levels = [(*names, start)]
        self.rounds = []
        for r in range(ROUNDS):
            sym, m = names[0], len(start)
            bit = (mix(sym + U(r + 1) * U(0x165667B19E3779F9)) >> U(63)).astype(bool)
            pair = np.zeros(m, bool)
            pair[:-1] = ~bit[:-1] & bit[1:] & ~head[1:]
            new = np.ones(m, bool)
            new[1:] = ~pair[:-1]
            self.rounds.append((bit, np.append(np.cumsum(new) - 1, new.sum())))
            keep = np.flatnonzero(new)
            joined, nxt = pair[keep], np.minimum(keep + 1, m - 1)
            names = tuple(np.where(joined, mix(x[keep] * U(0x9FB21C651E98DF25) + x[nxt] + U(1)), x[keep]) for x in names)
            start, head = start[keep], head[keep]
            self.levels.append((*names, start))

    def _cores(self, window: np.ndarray, size: int):
        """For each level: first and end symbol of every window's core, and which windows have a first or last symbol that the next round leaves out."""
        a, e = self.run[window] + 1, self.run[window + size - 1]
        for bit, parent in self.rounds:
            full = a < e
            ia, ie = np.where(full, a, 0), np.where(full, e, 1)
            left, right = full & bit[ia], full & ~bit[ie - 1]
            yield a, e, left, right
            a2, e2 = ia + left, ie - right
            full &= a2 < e2
            m = len(bit)
            a, e = np.where(full, parent[np.minimum(a2, m)], 0), np.where(full, parent[np.minimum(e2, m)], 0)
        none = np.zeros(len(window), bool)
        yield a, e, none, none

    def anchors(self, window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window (start index): word index, length and first name of its anchor; length 0 where it has no strong one.

        window: starts of windows of ``size`` words that lie within one document."""
        at = np.zeros(len(window), np.int64)
        length = np.zeros(len(window), np.int64)
        name = np.zeros(len(window), U)
        if not len(window):
            return at, length, name
        cores = [(a, e) for a, e, _, _ in self._cores(window, size)]
        open_ = np.arange(len(window))
        for (sym, _, start), (a, e) in zip(reversed(self.levels), reversed(cores)):
            a, e = a[open_], e[open_]
            full = np.flatnonzero(a < e)
            if not len(full):
                continue
            long = np.diff(np.append(start, len(self.h)))
            bits = U(max(1, int(len(sym)).bit_length()))
            key = ((U(63) - np.minimum(long, 63).astype(U)) << U(58)) | ((sym >> U(6)) >> bits << bits) | np.arange(len(sym), dtype=U)
            i = (_range_min(key, a[full], e[full]) & ((U(1) << bits) - U(1))).astype(np.int64)
            good = long[i] >= STRONG
            to, i = open_[full[good]], i[good]
            at[to], length[to], name[to] = start[i], long[i], sym[i]
            rest = np.ones(len(open_), bool)
            rest[full[good]] = False
            open_ = open_[rest]
        return at, length, name

    def keys(self, window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two names (64 and 32 bits) of each window's word sequence, from the symbols that spell it out."""
        if not len(window):
            return np.zeros(0, U), np.zeros(0, np.int32)
        last = window + size - 1
        edges = np.minimum(self.run_end[self.run[window]], last + 1) - window, last + 1 - np.maximum(self.run_start[self.run[last]], window)
        out = []
        for names, k in ((0, _KA), (1, _KB)):
            words = (self.h, self.g)[names]
            got = words[window] * k + edges[0].astype(U)
            got = (got * k + words[last]) * k + edges[1].astype(U)
            for level, (a, e, left, right) in zip(self.levels, self._cores(window, size)):
                sym = level[names]
                some = left | right
                i, j = np.where(left, a, 0), np.where(right, e, 1) - 1
                got = mix(got * k + np.where(left, sym[i], U(0)))
                got = np.where(some, got * k + np.where(right, sym[j], U(1)), got)
            sym, width = self.levels[-1][names], np.maximum(e - a, 0)
            got = got * k + width.astype(U)
            for j in range(int(width.max(initial=0))):
                there = j < width
                got = np.where(there, mix(got * k + sym[np.where(there, a + j, 0)]), got)
            out.append(mix(got))
        return out[0], (out[1] >> U(32)).astype(np.uint32).view(np.int32)
