"""Binary trees of a bounded depth as heaps of arrays, walked for many rows at once.

Node i has the children 2i+1 (value <= threshold) and 2i+2. A leaf above the last level hands its value down to
both sides, so every row takes the same number of steps.

A value is first replaced by its place among the feature's thresholds, one or two bytes. In the upper levels, of few
nodes, all nodes of a level are then compared with all rows, and each row's own answer is picked out bit by bit, which
costs a fraction of looking up each row's node. The lower levels look up the node of each row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

ROWS = 16384  # rows walked at a time, so that their features stay in the cache
TOGETHER = 4  # trees walked at a time
UPPER = 4  # levels whose nodes are all compared


def upper(level, rows: int, trees: int, depth: int) -> np.ndarray:
    """tree x row: the place in its level that each row has after ``depth`` (up to 8) levels; ``level`` tells of a slice
    of nodes (tree x node x row, one byte) whether a row goes to the high side there."""
    path, bits = np.zeros((trees, rows), np.uint8), []
    for d in range(depth):
        high = level(slice((1 << d) - 1, (2 << d) - 1))
        for bit in reversed(bits):  # of two neighbours the one on the row's side
            low = high[:, 0::2]
            high = low ^ ((low ^ high[:, 1::2]) & bit)
        bits.append(high)
        path = (path << 1) | high[:, 0]
    return path


def compared(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray):
    """``level`` of :func:`upper` over codes (feature x row): a code goes to the low side when it is the cut at most."""
    return lambda here: (codes[feature[:, here]] > cut[:, here, None]).view(np.uint8)


def lower(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, first: int, depth: int, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The place in level ``depth`` of all trees, one tree's nodes behind the other's, that some rows (columns of
    ``codes``) have; ``node`` (tree x row) is the place in the tree's level ``first``, and is used up."""
    flat = codes.ravel()
    node += np.arange(len(feature))[:, None] << first
    for d in range(first, depth):
        here = slice((1 << d) - 1, (2 << d) - 1)
        at = (feature[:, here].astype(np.intp) * codes.shape[1]).ravel().take(node, mode="clip")  # in range; the quicker mode
        at += rows
        high = flat.take(at, mode="clip") > cut[:, here].ravel().take(node, mode="clip")
        node *= 2
        node += high
    return node


@dataclass(frozen=True)
class Heaps:
    feature: np.ndarray    # tree x node; 0 where a row only passes through
    threshold: np.ndarray  # infinite there
    value: np.ndarray      # what a row gets at a node of the last level

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    @staticmethod
    def of_links(feature, threshold, left, right, value, roots, depth: int) -> "Heaps":
        """From nodes that name their children (feature -1: a leaf)."""
        shape, at, first = (len(roots), (2 << depth) - 1), np.asarray(roots)[:, None], 0
        f, t, v = np.zeros(shape, np.intp), np.full(shape, np.inf), np.zeros(shape)
        for d in range(depth + 1):
            inner, here = feature[at] >= 0, slice(first, first + (1 << d))
            f[:, here], t[:, here] = np.where(inner, feature[at], 0), np.where(inner, threshold[at], np.inf)
            v[:, here] = value[at]
            at = np.stack([np.where(inner, left[at], at), np.where(inner, right[at], at)], 2).reshape(len(roots), -1)
            first += 1 << d
        return Heaps(f, t, v)

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """The thresholds of each feature, in order."""
        told = np.isfinite(self.threshold)
        return [np.unique(self.threshold[told & (self.feature == c)]) for c in range(int(self.feature.max()) + 1)]

    @cached_property
    def places(self) -> np.ndarray:
        """tree x node: the place of the node's threshold among those of its feature; where a row only passes through
        the largest number, which sends it to the low side."""
        most = max(map(len, self.cuts))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if most < np.iinfo(k).max)
        out = np.full(self.threshold.shape, np.iinfo(kind).max, kind)
        for c, cuts in enumerate(self.cuts):
            here = np.isfinite(self.threshold) & (self.feature == c)
            out[here] = np.searchsorted(cuts, self.threshold[here])
        return out

    def total(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The (weighted) sum over all trees of the values that the rows reach."""
        out, depth, last = np.zeros(len(x)), self.depth, (1 << self.depth) - 1
        value = self.value[:, last:] if weights is None else self.value[:, last:] * np.asarray(weights)[:, None]
        for a in range(0, len(x), ROWS):
            part, total = x[a:a + ROWS], out[a:a + ROWS]
            # x <= a threshold if and only if as many thresholds or fewer lie below x; NaN lies above all.
            codes = np.stack([np.searchsorted(c, part[:, i]).astype(self.places.dtype) for i, c in enumerate(self.cuts)])
            rows = np.arange(len(part))
            for t in range(0, len(value), TOGETHER):
                f, c, top = self.feature[t:t + TOGETHER], self.places[t:t + TOGETHER], min(depth, UPPER)
                node = upper(compared(codes, f, c), len(part), len(f), top).astype(np.intp)
                node = lower(codes, f, c, top, depth, node, rows)
                for v in value[t:t + TOGETHER].ravel().take(node, mode="clip"):
                    total += v
        return out
