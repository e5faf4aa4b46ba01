"""A bulk-loaded R-tree over group-count vectors, joined with itself under an overlap bound.

A set is a point: how many of its members hash into each group.  Two sets share at most
``sum_g min(a_g, b_g)`` members, and boxes bound their points' overlap by the minima of their upper
corners, so Jaccard >= t needs ``sum_g min(hi_g, hi'_g) >= t / (1 + t) * (least size + least size')``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16
#: Pairs of leaves whose points are paired at once.
LEAVES = 4096
_CHUNK = 1 << 15


def pair_passes(counts_a: np.ndarray, counts_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the bounds leave Jaccard >= threshold possible, row by row."""
    out = np.empty(len(size_a), bool)
    for at in range(0, len(size_a), _CHUNK):
        s = slice(at, at + _CHUNK)
        most = np.minimum(counts_a[s], counts_b[s]).sum(1, dtype=np.int64)
        most = np.minimum(most, np.minimum(size_a[s], size_b[s]))
        out[s] = most * (1 + threshold) + 1e-6 >= threshold * (size_a[s].astype(np.int64) + size_b[s])
    return out


class CountRTree:
    """Levels of boxes, leaves first; ``order`` lists the points as the leaves hold them."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.counts, self.sizes, self.fanout = counts, sizes, fanout
        self.order = self._tiled(counts, sizes, fanout)
        high, low_size, high_size = counts[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while True:
            at = np.arange(0, len(high), fanout)
            high = np.maximum.reduceat(high, at, axis=0)
            low_size, high_size = np.minimum.reduceat(low_size, at), np.maximum.reduceat(high_size, at)
            self.levels.append((high, low_size, high_size))
            if len(at) == 1:
                break

    @staticmethod
    def _tiled(counts: np.ndarray, sizes: np.ndarray, fanout: int) -> np.ndarray:
        """Sort-tile-recursive order: slabs by size, and in each the coordinates that vary most."""
        n = len(sizes)
        order = np.argsort(sizes, kind="stable")
        spread = np.argsort(-counts.astype(np.float64).var(0), kind="stable")[:2]
        leaves = -(-n // fanout)
        slab = fanout * max(1, int(round(leaves ** (2 / 3))))
        strip = fanout * max(1, int(round(leaves ** (1 / 3))))
        for start in range(0, n, slab):
            part = order[start : start + slab]
            part = part[np.argsort(counts[part, spread[0]], kind="stable")]
            for at in range(0, len(part), strip):
                piece = part[at : at + strip]
                part[at : at + strip] = piece[np.argsort(counts[piece, spread[-1]], kind="stable")]
            order[start : start + slab] = part
        return order

    def join(self, other: CountRTree | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (positions here, and there) whose boxes no bound excludes, in pieces of some thousand leaves.

        Without another tree, every two of its own points once.
        """
        there = other or self
        height = max(len(self.levels), len(there.levels))
        left = right = np.zeros(1, np.int64)
        for depth in range(height - 1, 0, -1):
            keep = self._boxes_pass(there, depth, left, right, threshold)
            left, right = self._children(left[keep], right[keep], self._boxes(depth - 1), there._boxes(depth - 1), other is None)
        keep = self._boxes_pass(there, 0, left, right, threshold)
        left, right = left[keep], right[keep]
        for at in range(0, len(left), LEAVES):
            a, b = self._children(left[at : at + LEAVES], right[at : at + LEAVES], len(self.order), len(there.order), other is None)
            if other is None:
                a, b = a[a != b], b[a != b]
            yield self.order[a], there.order[b]

    def _boxes(self, depth: int) -> int:
        return len(self.levels[min(depth, len(self.levels) - 1)][1])

    def _boxes_pass(self, there: CountRTree, depth: int, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """A tree of fewer levels repeats its root above it."""
        high, low_size, high_size = self.levels[min(depth, len(self.levels) - 1)]
        high_there, low_there, high_size_there = there.levels[min(depth, len(there.levels) - 1)]
        out = (high_size[left] >= threshold * low_there[right] - 1e-6) & (high_size_there[right] >= threshold * low_size[left] - 1e-6)
        at = np.flatnonzero(out)
        for start in range(0, len(at), _CHUNK):
            s = at[start : start + _CHUNK]
            most = np.minimum(high[left[s]], high_there[right[s]]).sum(1, dtype=np.int64)
            out[s] = most * (1 + threshold) + 1e-6 >= threshold * (low_size[left[s]].astype(np.int64) + low_there[right[s]])
        return out

    def _children(self, left: np.ndarray, right: np.ndarray, below: int, below_there: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children, of one's own each unordered pair once."""
        k = np.arange(self.fanout)
        a = np.broadcast_to((left[:, None] * self.fanout + k)[:, :, None], (len(left), self.fanout, self.fanout)).reshape(-1)
        b = np.broadcast_to((right[:, None] * self.fanout + k)[:, None, :], (len(left), self.fanout, self.fanout)).reshape(-1)
        keep = (a < below) & (b < below_there)
        if own:
            keep &= a <= b
        return a[keep], b[keep]


def pair_passes_at(counts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    out = np.empty(len(a), bool)
    for at in range(0, len(a), _CHUNK):
        s = slice(at, at + _CHUNK)
        out[s] = pair_passes(counts[a[s]], counts[b[s]], sizes[a[s]], sizes[b[s]], threshold)
    return out
