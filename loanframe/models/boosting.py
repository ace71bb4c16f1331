"""Gradient-boosted trees for a 0/1 label (M4), grown from histograms of binned features.

fit
  1. A feature is cut at its distinct values or, where it has more than BINS, at its BINS-quantiles (of merged
     summaries of sorted rows). Each row is kept as one byte a feature and its label, in blocks of some ten thousand rows.
  2. A tree of depth k takes k jobs. Each task adds up the rows and pseudo-residuals by node, feature and bin; the
     sums of all tasks (some KB each) meet on the driver, which picks each node's best split. Below the root only the
     smaller child of each node is added up; the other has what is left of the node's sums. The bins of two or more
     features make one code of at most CODES values, so that a row is counted once for all of them.
  3. The rows' margins move on with each tree, as the blocks of the next one; every CHECKPOINT_EVERY trees they are
     checkpointed to the shared folder.
score
  A scalar ``pandas_udf`` walks all trees.

As in MLlib's GBTClassifier: log loss over labels -1 and 1, regression trees on its negative gradient, the first tree
with weight 1 and the others with the step size, and the probability 1 / (1 + exp(-2 margin)).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import feature_values
from .heaps import UPPER, Heaps, compared, lower, upper

BINS, BLOCK, CHECKPOINT_EVERY = 32, 1 << 16, 10
CODES = BINS * BINS  # values of one code of several features
STEP = 1 << 15  # rows of a block walked at a time
SORTED, POINTS = 1 << 18, 2048  # rows that a summary of order statistics tells of, and its values
# Blocks are kept as the bytes that go to Python: not decoded again in each pass.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
TASK_ROWS = 1 << 18  # a task starts as slowly as it counts this many rows


def _summary(x: np.ndarray) -> tuple[list[float], list[float]]:
    """The distinct values, BINS + 1 at most, and POINTS order statistics, evenly spaced, or all values where they are fewer."""
    x = np.sort(x[~np.isnan(x)])
    some = x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))[:BINS + 1]] if len(x) else x
    at = np.arange(len(x)) if len(x) <= POINTS else ((np.arange(POINTS) + 0.5) * len(x) / POINTS).astype(np.intp)
    return some.tolist(), x[at].tolist()


def _summaries(batches):
    """A row for each column and SORTED rows of a task: column, rows, and the :func:`_summary` of its values."""
    def told(held):
        for c in range(held[0].num_columns):
            x = np.concatenate([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in held])
            yield c, int((~np.isnan(x)).sum()), *_summary(x)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*told(held)), SUMMARY)], ["c", "n", "some", "points"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SORTED:
            yield batch(held)
            held, n = [], 0
    if n:
        yield batch(held)


SUMMARY = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]


def _cuts(told: pd.DataFrame) -> pd.DataFrame:
    """The thresholds of one column from its summaries."""
    some = np.unique(np.concatenate(told["some"].to_list()))
    if len(some) <= BINS:
        cuts = (some[:-1] + some[1:]) / 2
    else:
        x = np.concatenate(told["points"].to_list())
        weight = np.concatenate([np.full(len(p), n / len(p)) for n, p in zip(told["n"], told["points"]) if len(p)])
        order = np.argsort(x, kind="stable")
        below = np.cumsum(weight[order])
        at = np.searchsorted(below, np.arange(1, BINS) / BINS * below[-1] * (1 - 1e-12))
        cuts = np.unique(x[order][at])
    return pd.DataFrame({"c": [told["c"].iloc[0]], "cuts": [cuts.tolist()]})


def cut_points(values: DataFrame, cols: list[str]) -> list[np.ndarray]:
    """For each column the thresholds between its bins, over all rows: one pass, whose tasks sort their rows and tell of
    some thousand order statistics; those of a column meet in one group, a few KB for each SORTED rows. The rank of a
    threshold is off by a ``POINTS``-th of the rows at most."""
    told = values.select(*cols).mapInArrow(_summaries, "c int, n bigint, some array<double>, points array<double>")
    found = {r["c"]: r["cuts"] for r in told.groupBy("c").applyInPandas(_cuts, "c int, cuts array<double>").collect()}
    return [np.array(found[i], float) for i in range(len(cols))]


def _blocks(cuts: list[np.ndarray]):
    """Rows of (label, features) as blocks: bins (feature by row, one byte each) and label bytes."""
    def run(batches):
        def block(held):
            y, x = (np.concatenate(p) for p in zip(*held))
            bins = np.stack([np.searchsorted(c, x[:, i], side="left").astype(np.uint8) for i, c in enumerate(cuts)])
            return pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["bins", "label"])

        held, n = [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8), values))
            n += len(values)
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)
    return run


def residuals(sign: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The negative gradient of the log loss."""
    with np.errstate(over="ignore"):  # nothing is left of a row that far on its side
        return 4 * sign / (1 + np.exp(2 * sign * margin))


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, rows: np.ndarray) -> np.ndarray:
    """The node (of ``depth``) that rows of a block have in a tree over bins; a cut of BINS passes all to the low side."""
    feature, cut, first, n = feature[None], cut.astype(np.uint8)[None], min(depth, UPPER), bins.shape[1]
    parts = [bins[:, a:a + STEP] for a in range(0, n, STEP)]
    top = np.concatenate([upper(compared(part, feature, cut), part.shape[1], 1, first)[0] for part in parts])
    node = lower(bins, feature, cut, first, depth, top.take(rows).astype(np.intp)[None], rows)[0]
    node += (1 << depth) - 1
    return node


def packs(cuts: list[np.ndarray]) -> list[list[int]]:
    """The features in groups whose bins together make one code of CODES values at most."""
    out, room = [], []
    for c in sorted(range(len(cuts)), key=lambda c: -len(cuts[c])):
        size = len(cuts[c]) + 1
        at = next((i for i, r in enumerate(room) if size <= r), None)
        if at is None:
            out.append([])
            room.append(CODES)
            at = -1
        out[at].append(c)
        room[at] //= size
    return out


class Packing:
    """Codes of several features each: a level's sums are counted by code and then added up by feature and bin."""

    def __init__(self, cuts: list[np.ndarray]):
        self.groups, self.cols = packs(cuts), len(cuts)
        self.sizes = [[len(cuts[c]) + 1 for c in group] for group in self.groups]
        self.pack, self.bin = np.zeros(self.cols, np.intp), np.zeros((self.cols, CODES), np.uint8)
        for g, (group, sizes) in enumerate(zip(self.groups, self.sizes)):
            for c, bins in zip(group, np.unravel_index(np.arange(math.prod(sizes)), sizes)):
                self.pack[c], self.bin[c, :len(bins)] = g, bins

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """pack x row"""
        return np.stack([np.ravel_multi_index(tuple(bins[c].astype(np.intp) for c in group), sizes).astype(np.uint16)
                         for group, sizes in zip(self.groups, self.sizes)])

    def walk(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """The node (of ``depth``) that each row has in a tree over bins; a cut of BINS passes all to the low side."""
        high = (self.bin[feature] > cut[:, None]).view(np.uint8)  # node x code

        def level(here):
            return np.stack([high[i].take(codes[self.pack[feature[i]]], mode="clip") for i in range(here.start, here.stop)])[None]

        node = upper(level, codes.shape[1], 1, depth)[0].astype(np.intp)
        node += (1 << depth) - 1
        return node

    def sums(self, blocks, feature: np.ndarray, cut: np.ndarray, depth: int, side: np.ndarray | None = None) -> np.ndarray:
        """(rows, residuals) by feature, node of the level and bin, over blocks. With ``side`` one child alone of each node
        of the level before, the high one where that is 1, in the place of that node."""
        nodes = 1 << (depth if side is None else depth - 1)
        out = np.zeros((2, self.cols, nodes, BINS))
        shapes = [(nodes, *sizes) for sizes in self.sizes]
        held = [np.zeros((2, math.prod(shape))) for shape in shapes]
        for codes, _, _, r in blocks:
            r, rows = np.asarray(r, float), None
            node = self.walk(codes, feature, cut, depth) - ((1 << depth) - 1)
            if side is not None:
                rows = np.flatnonzero((np.arange(1 << depth) % 2 == np.repeat(side, 2)).take(node))
                node, r = node.take(rows) >> 1, r.take(rows)
            for sums, code in zip(held, codes):
                place = code.astype(np.intp) if rows is None else code.take(rows).astype(np.intp)
                if nodes > 1:
                    place += node * (len(sums[0]) // nodes)
                sums[0] += np.bincount(place, minlength=len(sums[0]))
                sums[1] += np.bincount(place, r, minlength=len(sums[1]))
        for sums, group, shape in zip(held, self.groups, shapes):
            for i, c in enumerate(group):
                others = tuple(k + 2 for k in range(len(group)) if k != i)
                out[:, c, :, :shape[i + 1]] = sums.reshape(2, *shape).sum(axis=others)
        return out


def both_sides(parent: np.ndarray, child: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The sums of a level: ``child`` has one child of each node of ``parent``, the other has what is left."""
    out, node = np.empty((*parent.shape[:2], 2 * parent.shape[2], parent.shape[3])), np.arange(len(side))
    out[:, :, 2 * node + side], out[:, :, 2 * node + 1 - side] = child, parent - child
    return out


def _histogram(packing: Packing, feature: np.ndarray, cut: np.ndarray, depth: int, side: np.ndarray | None, first: bool):
    """:meth:`Packing.sums` over a task's blocks; the first tree fits the labels themselves."""
    def run(blocks):
        opened = ((codes, sign.astype(np.float32), margin) for codes, sign, margin in blocks)
        yield packing.sums(((c, s, m, s if first else residuals(s, m)) for c, s, m in opened), feature, cut, depth, side)
    return run


def best_splits(hist: np.ndarray, least: int = 1) -> tuple[np.ndarray, ...]:
    """For each node: feature and bin of the split that lowers the variance most, (rows, sum) of its low side and of
    the node, and whether it gains anything."""
    n, s = np.cumsum(hist, axis=3)
    all_n, all_s = n[:, :, -1:], s[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (all_s - s) ** 2 / (all_n - n) - all_s ** 2 / all_n
    gain = np.where((n >= least) & (all_n - n >= least), gain, -np.inf)
    gain = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)  # node x (feature, bin)
    best = gain.argmax(1)
    f, b, node = best // BINS, best % BINS, np.arange(len(best))
    gains = gain[node, best] > 1e-9 * np.maximum(1.0, np.abs(all_s[0, :, 0]))
    return f, b, np.stack([n[f, node, b], s[f, node, b]]), np.stack([all_n[0, :, 0], all_s[0, :, 0]]), gains


def _link(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * F.lit(-2.0)))


class BoostedTrees:
    """Fitted boosted trees, used like an MLlib classifier: ``transform`` adds raw prediction, probability and prediction."""

    def __init__(self, heaps: Heaps, weights: np.ndarray):
        self.heaps, self.weights = heaps, weights
        self.probabilityCol, self.rawPredictionCol, self.predictionCol = "probability", "rawPrediction", "prediction"

    def setProbabilityCol(self, name: str) -> "BoostedTrees":
        self.probabilityCol = name
        return self

    def getProbabilityCol(self) -> str:
        return self.probabilityCol

    def setRawPredictionCol(self, name: str) -> "BoostedTrees":
        self.rawPredictionCol = name
        return self

    def setPredictionCol(self, name: str) -> "BoostedTrees":
        self.predictionCol = name
        return self

    def margin(self, features: list[Column]) -> Column:
        heaps, weights = self.heaps, self.weights

        @F.pandas_udf(T.DoubleType())
        def _margin(x: pd.DataFrame) -> pd.Series:
            return pd.Series(heaps.total(x.to_numpy(dtype=float), weights))
        return _margin(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(features)]))

    _link = staticmethod(_link)

    @staticmethod
    def _raw(margin: Column) -> Column:
        return F.array(-margin, margin)

    @staticmethod
    def _label(margin: Column) -> Column:
        return margin > 0

    def probability(self, features: list[Column]) -> Column:
        return self._link(self.margin(features))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        values = vector_to_array(F.col(features))
        out = df.withColumn("_m", self.margin([values[i] for i in range(int(self.heaps.feature.max()) + 1)]))
        m, p = F.col("_m"), self._link(F.col("_m"))
        return out.withColumns({self.rawPredictionCol: array_to_vector(self._raw(m)), self.probabilityCol: array_to_vector(F.array(1 - p, p)),
                                self.predictionCol: self._label(m).cast("double")}).drop("_m")

    # -------------------------------------------------------------- save and load
    def write(self) -> "BoostedTreesWriter":
        return BoostedTreesWriter(self)

    @classmethod
    def load(cls, path: str) -> "BoostedTrees":
        rows = sorted(tuple(r) for r in SparkSession.active().read.parquet(path).collect())
        trees = rows[-1][0] + 1
        f, t, v = (np.array([r[i] for r in rows], k).reshape(trees, -1) for i, k in ((3, np.intp), (4, float), (5, float)))
        return cls(Heaps(f, t, v), np.array([r[2] for r in rows]).reshape(trees, -1)[:, 0])


class BoostedTreesWriter:
    def __init__(self, model: BoostedTrees, mode: str = "error"):
        self.model, self.mode = model, mode

    def overwrite(self) -> "BoostedTreesWriter":
        return BoostedTreesWriter(self.model, "overwrite")

    def save(self, path: str) -> None:
        h = self.model.heaps
        rows = [(t, i, float(w), int(f), float(c), float(v)) for t, w in enumerate(self.model.weights)
                for i, (f, c, v) in enumerate(zip(h.feature[t], h.threshold[t], h.value[t]))]
        SparkSession.active().createDataFrame(rows, "tree int, node int, weight double, feature int, threshold double, value double").write.mode(
            self.mode).parquet(path)


def binned(train: DataFrame, n_cols: int) -> tuple[RDD, list[np.ndarray]]:
    """The rows of ``train`` (label 0 or 1, and the features) as blocks (place, bins, label), persisted and
    checkpointed so that a block keeps its rows, and the cut points of the features."""
    values = train.select(F.col("label"), feature_values(train).alias("v"))
    names = [f"c{i}" for i in range(n_cols)]
    cuts = cut_points(values.select(*[F.col("v")[i].alias(c) for i, c in enumerate(names)]), names)
    rows = values.mapInArrow(_blocks(cuts), "bins binary, label binary").coalesce(train.sparkSession.sparkContext.defaultParallelism)

    def placed(part, rows):
        for i, row in enumerate(rows):
            yield (part, i), np.frombuffer(row["bins"], np.uint8).reshape(n_cols, -1), np.frombuffer(row["label"], np.uint8)

    blocks = rows.rdd.mapPartitionsWithIndex(placed).persist(KEPT)
    blocks.checkpoint()
    blocks.count()
    return blocks, cuts


def fit_boosting(train: DataFrame, n_cols: int, n_trees: int, depth: int, step: float) -> BoostedTrees:
    """M4 on ``train`` (label 0 or 1, and the ``features`` vector)."""
    rows, cuts = binned(train, n_cols)
    try:
        return boost(rows, cuts, n_trees, depth, step)
    finally:
        rows.unpersist()


def boost(rows: RDD, cuts: list[np.ndarray], n_trees: int, depth: int, step: float) -> BoostedTrees:
    """M4 on the blocks of :func:`binned`."""
    packing = Packing(cuts)

    def opened(row):
        sign = row[2].astype(np.int8) * 2 - 1
        return packing.codes(row[1]), sign, np.zeros(len(sign), np.float32)

    # Small tables in fewer tasks than there are cores: each job is mostly the start of its Python tasks.
    tasks = -(-rows.map(lambda row: len(row[2])).sum() // TASK_ROWS)
    blocks = rows.coalesce(max(1, min(tasks, rows.getNumPartitions()))).map(opened).persist(KEPT)
    last, size, heaps, weights = None, (2 << depth) - 1, [], []
    try:
        for t in range(n_trees):
            feature, cut = np.zeros(size, np.intp), np.full(size, BINS)
            threshold, value = np.full(size, np.inf), np.zeros(size)
            side = hist = None
            for d in range(depth):
                counted = np.sum(blocks.mapPartitions(_histogram(packing, feature, cut, d, side, t == 0)).collect(), axis=0)
                hist = counted if side is None else both_sides(hist, counted, side)
                if last is not None:
                    last, _ = None, last.unpersist()
                f, b, low, all_, gains = best_splits(hist)
                if d == 0:
                    value[0] = all_[1, 0] / all_[0, 0]
                for k in range(1 << d):
                    i = (1 << d) - 1 + k
                    value[2 * i + 1] = value[2 * i + 2] = value[i]
                    if gains[k] and (d == 0 or cut[(i - 1) // 2] < BINS):
                        feature[i], cut[i], threshold[i] = f[k], b[k], cuts[f[k]][b[k]]
                        value[2 * i + 1] = low[1, k] / low[0, k]
                        value[2 * i + 2] = (all_[1, k] - low[1, k]) / (all_[0, k] - low[0, k])
                if not gains.any():
                    break
                # The next level counts the smaller child of each node; a node that is not split has an empty high one.
                here = slice((1 << d) - 1, (2 << d) - 1)
                side = ((cut[here] == BINS) | (2 * low[0] > all_[0])).astype(np.intp)
            heaps.append((feature, threshold, value))
            weights.append(step if t else 1.0)
            if t + 1 < n_trees:
                last, blocks = blocks, blocks.map(_moved(packing, feature, cut, value * weights[-1], depth)).persist(KEPT)
                if (t + 1) % CHECKPOINT_EVERY == 0:
                    blocks.checkpoint()
    finally:
        blocks.unpersist()
        if last is not None:
            last.unpersist()
    return BoostedTrees(Heaps(*(np.stack(x) for x in zip(*heaps))), np.array(weights))


def _moved(packing: Packing, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int):
    """A block with the margins after one more tree. Pseudo-residuals follow from them, so they are not kept."""
    def run(block):
        codes, sign, margin = block
        return codes, sign, margin + value.astype(np.float32).take(packing.walk(codes, feature, cut, depth))
    return run
