"""Isolation forest (M5, M6): anomaly decision scores for the early-warning bonus.

MLlib has no isolation forest, so it is built from Spark pieces:

fit
  1. Hash-uniforms (``xxhash64`` of the row key, tree and seed: independent
     of partitioning, so a re-run task draws the same numbers) pick each
     row for each tree with a small probability ``p``; a one-hash gate per
     row spares most rows the per-tree draws. Picked rows are exploded
     into (tree, row) pairs: about ``n_trees * (psi + margin)`` rows in
     total, whatever the table size.
  2. ``row_number`` per tree keeps the ``psi`` smallest draws: a uniform
     sample without replacement of ``psi`` rows per tree (each window
     partition is ~psi rows, bounded).
  3. ``groupBy(tree).applyInPandas`` grows one isolation tree per group
     (<= 256 rows each) and returns its nodes.
  4. The node table (<= n_trees * (2 * psi - 1) rows, about 51k) is the
     model. It is the only thing collected to the driver.
score
  A scalar ``pandas_udf`` walks the trees for an Arrow batch with NumPy
  (all rows at once, see :mod:`heaps`); the node arrays travel in the UDF
  closure (a few hundred KB).
offset
  The contamination-quantile of the unrounded training scores, exact at
  every size: its rank is found by refining a histogram.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import hash_uniform
from ..operators.ranks import quantile
from ..session import materialize
from .heaps import Heaps

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def avg_path_length(m) -> np.ndarray:
    """c(m): average unsuccessful-search path length in a BST of m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    two = m == 2
    big = m > 2
    out[two] = 1.0
    mb = m[big]
    out[big] = 2.0 * (np.log(mb - 1.0) + EULER_GAMMA) - 2.0 * (mb - 1.0) / mb
    return out


def grow_tree(x: np.ndarray, tree: int, height_limit: int, seed: int) -> list[tuple]:
    """Grow one isolation tree on the sample ``x`` (rows x features).

    A node splits on a random non-constant feature at a uniform threshold
    between that feature's min and max (left: value <= threshold); it is a
    leaf at the height limit, with <= 1 row, or when every feature is
    constant.
    """
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(idx), depth])
        if parent >= 0:
            nodes[parent][4 if side == "L" else 5] = me
        if depth >= height_limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            continue
        f = int(rng.choice(candidates))
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:  # keep both sides non-empty
            thr = float(np.nextafter(hi[f], lo[f]))
        go_left = sub[:, f] <= thr
        nodes[me][2], nodes[me][3] = f, thr
        stack.append((idx[~go_left], depth + 1, me, "R"))
        stack.append((idx[go_left], depth + 1, me, "L"))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    feature: np.ndarray      # per global node: split feature, -1 for a leaf
    threshold: np.ndarray
    left: np.ndarray         # global child indices
    right: np.ndarray
    leaf_path: np.ndarray    # depth + c(size), used at leaves
    roots: np.ndarray        # global index of each tree's root
    psi: int
    max_depth: int
    offset: float = 0.0

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, psi: int) -> "IsolationForestModel":
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        trees = nodes["tree"].to_numpy()
        starts = {t: i for i, t in enumerate(trees) if i == 0 or trees[i - 1] != t}
        base = np.array([starts[t] for t in trees])
        left = np.where(nodes["left"].to_numpy() >= 0, nodes["left"].to_numpy() + base, -1)
        right = np.where(nodes["right"].to_numpy() >= 0, nodes["right"].to_numpy() + base, -1)
        leaf_path = nodes["depth"].to_numpy(float) + avg_path_length(nodes["size"].to_numpy())
        return IsolationForestModel(
            feature=nodes["feature"].to_numpy(np.int64), threshold=nodes["threshold"].to_numpy(float),
            left=left.astype(np.int64), right=right.astype(np.int64), leaf_path=leaf_path,
            roots=np.array(sorted(starts.values()), dtype=np.int64), psi=psi,
            max_depth=int(nodes["depth"].max()))

    @cached_property
    def heaps(self) -> Heaps:
        return Heaps.of_links(self.feature, self.threshold, self.left, self.right, self.leaf_path, self.roots, self.max_depth)

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E[h(x)] / c(psi)); lower is more anomalous."""
        mean_path = self.heaps.total(x) / len(self.roots)
        return -np.power(2.0, -mean_path / float(avg_path_length([self.psi])[0]))

    def node_rows(self) -> list[tuple]:
        """The nodes as plain rows: at, feature, threshold, left, right, leaf_path, and whether it is a root."""
        roots = set(self.roots.tolist())
        return [(i, int(f), float(t), int(a), int(b), float(p), i in roots) for i, (f, t, a, b, p) in enumerate(
            zip(self.feature, self.threshold, self.left, self.right, self.leaf_path))]

    @staticmethod
    def from_node_rows(rows: list[tuple], psi: int, max_depth: int, offset: float) -> "IsolationForestModel":
        at = sorted(rows)
        kinds = (np.int64, float, np.int64, np.int64, float)
        feature, threshold, left, right, path = (np.array([r[i + 1] for r in at], k) for i, k in enumerate(kinds))
        return IsolationForestModel(feature, threshold, left, right, path, np.array([r[0] for r in at if r[6]], np.int64),
                                    psi, max_depth, offset)

    def score_udf(self):
        model = self

        @F.pandas_udf(T.DoubleType())
        def _score(feats: pd.DataFrame) -> pd.Series:
            return pd.Series(model.score_samples(feats.to_numpy(dtype=float)))
        return _score

    def score_column(self, feature_cols: list[str]) -> Column:
        """score_samples as a column over the given feature columns."""
        return self.score_udf()(F.struct(*[F.col(c) for c in feature_cols]))

    def decision_column(self, feature_cols: list[str]) -> Column:
        """decision_function = score_samples - offset (negative = anomalous)."""
        return self.score_column(feature_cols) - F.lit(self.offset)


def tree_samples(train: DataFrame, feature_cols: list[str], key: str, n: int, n_trees: int, psi: int,
                 seed: int = 42) -> DataFrame:
    """Rows (tree, key, features): for each tree a uniform sample without
    replacement of ``psi`` of the ``n`` training rows."""
    # Inclusion probability with a wide margin so every tree sees >= psi
    # candidates (the expected count sits ~8 standard deviations above psi).
    p = min(1.0, (psi + 8.0 * math.sqrt(psi) + 16.0) / max(n, 1))
    # Two-level draw: one hash per row opens a gate with probability
    # q = min(1, n_trees * p); only rows through the gate draw per tree, with
    # probability p / q, so each tree still takes every row with probability
    # p and almost every row of a large table stops after a single hash. The
    # draw is made the same way at every size (a gate of 1 lets all through).
    # It hashes the whole training row and a row number, so rows that share an
    # id, or have none, are still drawn one by one. The rows that pass the gate
    # are stored with their numbers, the others are read once.
    q = min(1.0, n_trees * p)
    unit = [F.col("_unit"), F.col(key), *[F.col(c) for c in feature_cols]]
    gate = hash_uniform(*unit, F.lit(-1), seed=seed) < F.lit(q)
    numbered = materialize(train.select(key, *feature_cols).withColumn("_unit", F.monotonically_increasing_id()).where(gate),
                           "isolation-rows")
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: hash_uniform(*unit, t, seed=seed) < F.lit(p / q))
    cand = (numbered.withColumn("tree", F.explode(trees))
            .withColumn("_u", hash_uniform(*unit, F.col("tree"), seed=seed)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_u", "_unit"))
    return cand.withColumn("_r", rank).where(F.col("_r") <= psi).drop("_r", "_u", "_unit")


def fit_isolation_forest(train: DataFrame, feature_cols: list[str], key: str, n: int, contamination: float,
                         n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> IsolationForestModel:
    """M5: fit on ``train`` (``n`` rows, already counted by the caller)."""
    psi = int(min(max_samples, n))
    height_limit = int(math.ceil(math.log2(max(psi, 2))))
    sample = tree_samples(train, feature_cols, key, n, n_trees, psi, seed)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rows = grow_tree(pdf[feature_cols].to_numpy(dtype=float), t, height_limit, seed)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = IsolationForestModel.from_nodes(nodes, psi)
    scores = materialize(train.select(model.score_column(feature_cols).alias("s")), "isolation-scores")
    model.offset = quantile(scores, "s", float(contamination))
    return model
