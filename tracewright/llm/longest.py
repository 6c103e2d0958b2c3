"""Longest verbatim matches between texts and test items that share windows, from an array of whole suffixes.

Each place of a text or an item at which a shared window begins is a suffix of windows, up to the first place where none begins:
no match goes beyond. The suffixes are ranked by prefix doubling. A suffix's longest match with an item (or a text) is with one of
its two neighbours of that item (or text) in the order of ranks, and the ranks of all doublings tell how long it is.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The suffixes of several texts' windows; text, at and window of each place have to be sorted by (text, at)."""

    def __init__(self, text: np.ndarray, at: np.ndarray, window: np.ndarray):
        n = len(text)
        new = np.ones(n, bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        self.end = np.append(first[1:], n)[np.cumsum(new) - 1]
        self.names = [np.unique(window, return_inverse=True)[1].astype(np.int64)]
        longest, step, here = int((self.end - np.arange(n)).max(initial=0)), 1, np.arange(n)
        while step < longest:
            name = self.names[-1]
            after = here + step
            follows = np.where(after < self.end, name[np.minimum(after, n - 1)] + 1, 0)
            self.names.append(np.unique(name * (n + 1) + follows, return_inverse=True)[1].astype(np.int64))
            step *= 2
        self.rank = self.names[-1]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Windows that the suffixes a and b have in common from their begin on."""
        begin, last, other, n = a, self.end[a], self.end[b], len(self.end)
        a, b = a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            same = (a < last) & (b < other) & (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)])
            # suffixes that end within 2^k windows have equal names only if they end alike
            step = np.where(same, np.minimum(1 << k, last - a), 0)
            a += step
            b += step
        return a - begin


def neighbours(pair: np.ndarray, suffix: np.ndarray, is_item: np.ndarray, of: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each row the suffix of the pair's other side that agrees with it longest (of two, the lesser), and for how many
    windows. Rows are the suffixes of a text and of an item that share windows."""
    order = np.lexsort((suffix, of.rank[suffix], pair))
    pair, suffix, is_item = pair[order], suffix[order], is_item[order]
    n = len(order)
    here = np.arange(n)
    best, length = np.full(n, -1), np.zeros(n, np.int64)
    for back in (True, False):
        near = []
        for side in (False, True):
            at = np.where(is_item == side, here, -1 if back else n)
            near.append(np.maximum.accumulate(at) if back else np.minimum.accumulate(at[::-1])[::-1])
        other = np.where(is_item, near[0], near[1])
        there = np.clip(other, 0, n - 1)
        some = np.flatnonzero((other >= 0) & (other < n) & (pair[there] == pair))
        found = of.shared(suffix[some], suffix[there[some]])
        better = (found > length[some]) | ((found == length[some]) & (suffix[there[some]] < best[some]))
        some, found = some[better], found[better]
        best[some], length[some] = suffix[there[some]], found
    out, size = np.empty(n, np.int64), np.empty(n, np.int64)
    out[order], size[order] = best, length
    return out, size


def cover(pair: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows that cover, pair by pair and from left to right, all that the intervals cover, each the one that reaches
    furthest; what lies within another interval is left out."""
    if not len(pair):
        return np.zeros(0, np.int64)
    wide = int((start + size).max()) + 1
    order = np.lexsort((-size, start, pair))
    begin = np.unique(pair, return_inverse=True)[1][order] * wide + start[order]
    end = begin + size[order]
    furthest = np.maximum.accumulate(end)
    keep = np.ones(len(end), bool)
    keep[1:] = end[1:] > furthest[:-1]
    order, begin, end = order[keep], begin[keep], end[keep]
    after = np.maximum(np.searchsorted(begin, end, "right") - 1, np.arange(len(end)) + 1).tolist()
    chosen, i = [], 0
    while i < len(after):
        chosen.append(i)
        i = after[i]
    return order[chosen]
