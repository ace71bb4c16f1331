"""Random forest for a 0/1 label (M3), grown from histograms of binned features.

fit
  All trees grow together, one pass over the blocks of :mod:`boosting` a level. A task adds up the drawn rows and their
  labels by tree, node, feature and bin; the sums meet tree by tree in a shuffle, where each tree's best splits are
  picked. The driver gets the splits alone. A block's rows are drawn anew in each pass, by its place in the stored
  blocks, so no state of a row is kept between levels.
score
  A scalar ``pandas_udf`` walks all trees.

As in MLlib's and scikit-learn's forests: bootstrap of all rows (Poisson draws), the square root of the features at
each node, Gini gain, and the mean of the leaves' shares as probability. As in scikit-learn, and unlike MLlib, sister
leaves with the same majority stay apart, so their shares count.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import RDD
from pyspark.sql import Column
from pyspark.sql import functions as F

from .boosting import BINS, BoostedTrees, best_splits, walk
from .heaps import Heaps

# Draws of a Poisson variable of mean 1 by a 16-bit number.
_SHARES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(9)])
POISSON = np.searchsorted(_SHARES, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
_SHIFT = 2.0 ** 26  # counts and labels of a block in one sum


class BaggedTrees(BoostedTrees):
    """A fitted forest: each tree counts alike, and the sum is the probability itself."""

    def __init__(self, heaps: Heaps, weights: np.ndarray, importances: np.ndarray | None = None):
        super().__init__(heaps, weights)
        self.importances = importances

    @staticmethod
    def _link(total: Column) -> Column:
        return total

    @staticmethod
    def _raw(total: Column) -> Column:
        return F.array(F.lit(1.0) - total, total)

    @staticmethod
    def _label(total: Column) -> Column:
        return total > 0.5


def draws(seed: int, tree: int, block: tuple[int, int], n: int) -> np.ndarray:
    """How often each of a block's rows is drawn for a tree."""
    numbers = np.random.Generator(np.random.SFC64([seed, tree, *block])).integers(0, 1 << 64, -(-n // 4), dtype=np.uint64)
    return POISSON.take(numbers.view(np.uint16)[:n])


def candidates(seed: int, tree: int, depth: int, cols: int, taken: int) -> np.ndarray:
    """The features that each node of a level may split on: node x place."""
    every = np.tile(np.arange(cols), (1 << depth, 1))
    return np.random.default_rng([seed, tree, depth]).permuted(every, axis=1)[:, :taken]


def _histograms(feature: np.ndarray, cut: np.ndarray, depth: int, cols: int, taken: int, seed: int):
    """For each tree (drawn rows, labels) by candidate, node of the level and bin, summed over a task's blocks."""
    def run(blocks):
        trees, nodes, size = len(feature), 1 << depth, BINS << depth
        picked = [candidates(seed, t, depth, cols, taken) for t in range(trees)]
        out = None
        for block, bins, label in blocks:
            if out is None:
                out = np.zeros((trees, 2, taken, size), np.int64)
            n, flat = bins.shape[1], bins.ravel()
            labelled = 1.0 + _SHIFT * label
            for t in range(trees):
                drawn = draws(seed, t, block, n)
                rows = np.flatnonzero(drawn != 0)
                weight = (labelled * drawn).take(rows)
                if depth:
                    node = walk(bins, feature[t], cut[t], depth, rows) - (nodes - 1)
                    at = node * BINS
                for j in range(taken):
                    if depth:
                        place = (picked[t][:, j] * n).take(node, mode="clip")  # in range; the quicker mode
                        place += rows
                        place = flat.take(place, mode="clip") + at
                    else:
                        place = bins[picked[t][0, j]].take(rows)
                    both = np.bincount(place, weight, minlength=size)
                    ones = np.floor(both / _SHIFT)
                    out[t, 0, j] += (both - ones * _SHIFT).astype(np.int64)
                    out[t, 1, j] += ones.astype(np.int64)
        if out is not None:
            for t in range(trees):
                yield t, out[t].reshape(2, taken, nodes, BINS)
    return run


def _splits(least: int):
    def run(hist):
        f, b, low, all_, gains = best_splits(hist.astype(float), least)
        n, s = all_
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low[1] ** 2 / low[0] + (s - low[1]) ** 2 / (n - low[0]) - s ** 2 / n
        return f, b, low, all_, gains, gain
    return run


def fit_forest(blocks: RDD, cuts: list[np.ndarray], n_trees: int, depth: int, least: int, seed: int) -> BaggedTrees:
    """M3 on the blocks of ``boosting.binned``."""
    cols, size = len(cuts), (2 << depth) - 1
    taken = math.ceil(math.sqrt(cols))
    feature, cut = np.zeros((n_trees, size), np.int16), np.full((n_trees, size), BINS, np.int16)
    threshold, value = np.full((n_trees, size), np.inf), np.zeros((n_trees, size))
    importance = np.zeros((n_trees, cols))
    for d in range(depth):
        sums = blocks.mapPartitions(_histograms(feature, cut, d, cols, taken, seed)).reduceByKey(np.add)
        for t, (f, b, low, all_, gains, gain) in sums.mapValues(_splits(least)).collect():
            picked = candidates(seed, t, d, cols, taken)
            if d == 0:
                value[t, 0] = all_[1, 0] / all_[0, 0] if all_[0, 0] else 0.0
            for k in range(1 << d):
                i = (1 << d) - 1 + k
                value[t, 2 * i + 1] = value[t, 2 * i + 2] = value[t, i]
                if gains[k] and (d == 0 or cut[t, (i - 1) // 2] < BINS):
                    c = picked[k, f[k]]
                    feature[t, i], cut[t, i], threshold[t, i] = c, b[k], cuts[c][b[k]]
                    value[t, 2 * i + 1] = low[1, k] / low[0, k]
                    value[t, 2 * i + 2] = (all_[1, k] - low[1, k]) / (all_[0, k] - low[0, k])
                    importance[t, c] += gain[k]
    # A feature's share of each tree's gain, then of all trees'.
    total = importance.sum(1, keepdims=True)
    share = np.divide(importance, total, out=np.zeros_like(importance), where=total > 0).sum(0)
    heaps = Heaps(feature.astype(np.intp), threshold, value)
    return BaggedTrees(heaps, np.full(n_trees, 1.0 / n_trees), share / share.sum() if share.sum() else share)
