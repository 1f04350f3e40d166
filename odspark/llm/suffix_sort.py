"""Sorting of suffixes by comparing hashes.

The common extension of two suffixes is found by binary search on prefix
polynomial hashes; the byte behind it decides the order. Suffixes are sorted
bottom-up by mergesort, where the place of each element in the run it merges
with comes from a binary search over that run, for all elements of a level at
once. Neighbouring extensions are verified byte by byte at the end, so a hash
collision cannot pass unnoticed: the sort is then repeated with another base.
"""

from __future__ import annotations

import numpy as np

from odspark.llm import rolling as R


class Suffixes:
    """Suffixes ``data[start[i]:end[i]]``, sorted within equal ``group``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.start, self.end, self.group = data, start.astype(np.int64), end.astype(np.int64), group
        for which in (0, 1):
            self.h, self.which = R.byte_prefix(data, which), which
            self._sort()
            if self._verified():
                return
        raise RuntimeError("both hash bases collided")

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by binary search."""
        a, b = self.start[i], self.start[j]
        lo = np.zeros(len(i), np.int64)
        hi = np.minimum(self.end[i] - a, self.end[j] - b)
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = R.byte_span(self.h, a, a + mid, self.which) == R.byte_span(self.h, b, b + mid, self.which)
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j: by group, text, then number."""
        n = self.extension(i, j)
        a, b = self.start[i] + n, self.start[j] + n
        ended_i, ended_j = a >= self.end[i], b >= self.end[j]
        x = self.data[np.minimum(a, len(self.data) - 1)]
        y = self.data[np.minimum(b, len(self.data) - 1)]
        text = np.where(ended_i | ended_j, ended_i & (~ended_j | (i < j)), x < y)
        gi, gj = self.group[i], self.group[j]
        return np.where(gi == gj, text, gi < gj)

    def _sort(self) -> None:
        n = len(self.start)
        order = np.arange(n)
        # groups are brought together first: then only equal groups compare texts
        order = order[np.argsort(self.group, kind="stable")]
        width = 1
        rank = np.arange(n)
        while width < n:
            run = rank // width
            other = np.minimum((run ^ 1) * width, n)
            stop = np.minimum(other + width, n)
            lo, hi = other.copy(), stop.copy()
            # runs whose neighbours are of other groups are already in place
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                i, j = order[open_], order[mid]
                gi, gj = self.group[i], self.group[j]
                less = gj < gi
                same = np.flatnonzero(gi == gj)
                if len(same):
                    less[same] = self.before(j[same], i[same])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            base = np.minimum(run * width, other)
            place = base + (rank - run * width) + (lo - other)
            new = np.empty(n, order.dtype)
            new[place] = order
            order, width = new, width * 2
        self.order = order
        self.common = np.zeros(n, np.int64)
        if n > 1:
            i, j = order[:-1], order[1:]
            self.common[1:] = np.where(self.group[i] == self.group[j], self.extension(i, j), -1)

    def _verified(self) -> bool:
        """Each neighbouring extension holds byte by byte and ends where it says."""
        if len(self.order) < 2:
            return True
        i, j, n = self.order[:-1], self.order[1:], self.common[1:]
        use = np.flatnonzero(n >= 0)
        i, j, n = i[use], j[use], n[use]
        for a in range(0, len(use), 4096):
            m = n[a:a + 4096]
            total = int(m.sum())
            row = np.repeat(np.arange(len(m)), m)
            at = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
            p, q = self.start[i[a:a + 4096]], self.start[j[a:a + 4096]]
            if not np.array_equal(self.data[p[row] + at], self.data[q[row] + at]):
                return False
            x, y = p + m, q + m
            more = (x < self.end[i[a:a + 4096]]) & (y < self.end[j[a:a + 4096]])
            if (self.data[x[more]] >= self.data[y[more]]).any():
                return False
        return True


def classes(s: Suffixes, length: int) -> np.ndarray:
    """Class number per suffix: equal for suffixes of one group with the same first ``length`` bytes."""
    out = np.empty(len(s.order), np.int64)
    out[s.order] = np.cumsum(s.common < length)
    return out
