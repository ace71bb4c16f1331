"""K-means segments (M7) over blocks of rows.

fit
  The rows are kept as blocks of single-precision values, half of what the vectors take. A pass multiplies a block with
  the centres and adds up rows and values by nearest centre; the sums of all tasks (some numbers a centre) meet on the
  driver. Start and end are those of MLlib's KMeans: k-means|| in two steps with 2k candidates each, of which k-means++
  by the rows nearest to each picks k, then up to 20 passes, or until no centre moves by more than the tolerance.
score
  One expression, see :class:`compiled.Centres`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BLOCK, KEPT
from .compiled import Centres
from .features import feature_values

STEPS, PASSES, TOLERANCE = 2, 20, 1e-4
LOCAL_PASSES = 30  # over the few candidates


@dataclass(frozen=True)
class Segments(Centres):
    """Fitted centres, which outlive their session."""

    def cluster(self) -> Column:
        # An array, so that a distance over all features is told once.
        distances = F.array(*self.distances())
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")

    def write(self) -> "SegmentsWriter":
        return SegmentsWriter(self)

    @classmethod
    def load(cls, path: str) -> "Segments":
        rows = sorted(tuple(r) for r in SparkSession.active().read.parquet(path).collect())
        return cls(tuple(rows[0][1]), tuple(tuple(r[2]) for r in rows))


class SegmentsWriter:
    def __init__(self, model: Segments, mode: str = "error"):
        self.model, self.mode = model, mode

    def overwrite(self) -> "SegmentsWriter":
        return SegmentsWriter(self.model, "overwrite")

    def save(self, path: str) -> None:
        rows = [(i, list(self.model.features), [float(x) for x in c]) for i, c in enumerate(self.model.centres)]
        SparkSession.active().createDataFrame(rows, "centre int, features array<string>, place array<double>").write.mode(self.mode).parquet(path)


def value_blocks(train: DataFrame, cols: int) -> RDD:
    """The features of ``train`` as blocks (feature x row, single precision), persisted."""
    def run(batches):
        def block(held):
            x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, cols) for b in held])
            return pa.RecordBatch.from_arrays([pa.array([x.T.astype(np.float32).tobytes()], pa.binary())], ["x"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    rows = train.select(feature_values(train).alias("v")).mapInArrow(run, "x binary").coalesce(train.sparkSession.sparkContext.defaultParallelism)
    return rows.rdd.map(lambda r: np.frombuffer(r["x"], np.float32).reshape(cols, -1)).persist(KEPT)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block (feature x row) the nearest centre, ties to the first, and the squared distance to it."""
    part = -2.0 * (centres @ x) + (centres * centres).sum(1)[:, None]
    at, best = np.zeros(x.shape[1], np.intp), part[0]
    for k in range(1, len(part)):
        nearer = part[k] < best
        at[nearer], best = k, np.minimum(best, part[k])
    return at, np.maximum(best + (x * x).sum(0), 0.0)


def _sums(centres: np.ndarray):
    """(rows and values by nearest centre, cost), summed over a task's blocks."""
    def run(blocks):
        out, cost = np.zeros((len(centres), centres.shape[1] + 1)), 0.0
        for x in blocks:
            x = x.astype(float)
            at, d = nearest(x, centres)
            of = (at == np.arange(len(centres))[:, None]).astype(float)
            out[:, 0] += of.sum(1)
            out[:, 1:] += of @ x.T
            cost += d.sum()
        yield out, cost
    return run


def summed(blocks: RDD, centres: np.ndarray) -> tuple[np.ndarray, float]:
    parts = blocks.mapPartitions(_sums(centres)).collect()
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def _any(seed: int):
    """A row of the task, each as likely as the other, and a number whose largest over all tasks tells one of all rows."""
    def run(part, blocks):
        rng, best = np.random.default_rng([seed, part]), None
        for x in blocks:
            draw = rng.random() ** (1.0 / x.shape[1])
            if best is None or draw > best[0]:
                best = draw, x[:, rng.integers(x.shape[1])].astype(float)
        return [] if best is None else [best]
    return run


def _drawn(seed: int, step: int, centres: np.ndarray, rate: float):
    """Rows drawn in proportion to their cost."""
    def run(part, blocks):
        rng = np.random.default_rng([seed, step, part])
        for x in blocks:
            x = x.astype(float)
            yield from x[:, rng.random(x.shape[1]) < rate * nearest(x, centres)[1]].T
    return run


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """K-means++ over weighted points."""
    centres = points[[rng.choice(len(points), p=weight / weight.sum())]]
    while len(centres) < k:
        cost = weight * nearest(points.T, centres)[1]
        if not cost.sum():
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=cost / cost.sum())]])
    for _ in range(LOCAL_PASSES):
        at, before = nearest(points.T, centres)[0], centres.copy()
        for i in range(len(centres)):
            if weight[at == i].sum():
                centres[i] = np.average(points[at == i], axis=0, weights=weight[at == i])
        if (centres == before).all():
            break
    return centres


def start(blocks: RDD, k: int, seed: int) -> np.ndarray:
    """K-means||: the first centres."""
    centres = max(blocks.mapPartitionsWithIndex(_any(seed)).collect(), key=lambda d: d[0])[1][None]
    for step in range(STEPS):
        cost = summed(blocks, centres)[1]
        if not cost:
            break
        drawn = blocks.mapPartitionsWithIndex(_drawn(seed, step, centres, 2.0 * k / cost)).collect()
        centres = np.unique(np.vstack([centres, *drawn]), axis=0)
    if len(centres) <= k:
        return centres
    weight = summed(blocks, centres)[0][:, 0]
    return _plus_plus(centres, weight, k, np.random.default_rng(seed))


def fit_segments(train: DataFrame, features: list[str], k: int, seed: int) -> Segments:
    """M7 on the features of ``train``, named ``features`` as columns."""
    blocks = value_blocks(train, len(features))
    try:
        centres = start(blocks, k, seed)
        for _ in range(PASSES):
            rows, before = summed(blocks, centres)[0], centres
            some = rows[:, :1] > 0  # a centre that no row is near stays
            centres = np.where(some, rows[:, 1:] / np.where(some, rows[:, :1], 1.0), before)
            if (((centres - before) ** 2).sum(1) <= TOLERANCE ** 2).all():
                break
    finally:
        blocks.unpersist()
    return Segments(tuple(features), tuple(tuple(c) for c in centres.tolist()))
