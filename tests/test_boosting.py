"""Boosted trees over histograms against plain NumPy and MLlib, and trees as heaps against a plain walk."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanframe.models.boosting import BINS, CODES, BoostedTrees, Packing, best_splits, boost, cut_points, fit_boosting, walk
from loanframe.models.features import STD_COLS, FeatureEncoder
from loanframe.models.isoforest import NODE_SCHEMA, IsolationForestModel, grow_tree
from loanframe.plans.catalog import loans


@pytest.fixture(scope="module")
def train(spark):
    base = loans(spark, "/root/testdata/sf0.001")
    return FeatureEncoder.fit(base).transform(base).withColumn("label", F.col("default_indicator").cast("double")).persist()


def test_heaps_score_like_a_plain_walk():
    rng = np.random.default_rng(0)
    nodes = pd.DataFrame([n for t in range(7) for n in grow_tree(rng.normal(size=(200, 3)), t, 8, 1)], columns=NODE_SCHEMA.names)
    model, x = IsolationForestModel.from_nodes(nodes, 200), rng.normal(size=(9000, 3))
    x[5, 1] = np.nan
    heaps = __import__("loanframe.models.heaps", fromlist=["Heaps"]).Heaps.of_links(
        model.feature, model.threshold, model.left, model.right, model.leaf_path, model.roots, model.max_depth)

    def path(row):
        total = 0.0
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.leaf_path[at]
        return total
    assert np.allclose(heaps.total(x)[:50], [path(r) for r in x[:50]], rtol=0, atol=1e-9)
    assert np.allclose(heaps.total(x)[-50:], [path(r) for r in x[-50:]], rtol=0, atol=1e-9)


def test_splits_lower_the_variance_most():
    rng = np.random.default_rng(1)
    bins, r = rng.integers(0, 6, (3, 400)), rng.normal(size=400)
    r[bins[2] > 3] += 2.0
    hist = np.zeros((2, 3, 1, BINS))
    for c in range(3):
        hist[0, c, 0] += np.bincount(bins[c], minlength=BINS)
        hist[1, c, 0] += np.bincount(bins[c], r, minlength=BINS)
    f, b, low, all_, gains = best_splits(hist)
    spread = {(c, k): r[bins[c] <= k].var() * (bins[c] <= k).sum() + r[bins[c] > k].var() * (bins[c] > k).sum() for c in range(3) for k in range(5)}
    assert (f[0], b[0]) == min(spread, key=spread.get) == (2, 3) and gains[0]
    assert low[0, 0] == (bins[2] <= 3).sum() and abs(all_[1, 0] - r.sum()) < 1e-9


def test_packed_sums_are_plain_sums():
    """Several features share a code; nodes and sums are those of the features one by one."""
    rng, n = np.random.default_rng(3), 3000
    sizes = [BINS, BINS, 5, 7, 1, 2, BINS, BINS, 24]
    bins, r = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8), rng.normal(size=n)
    packing = Packing([np.arange(s - 1.0) for s in sizes])
    assert len(packing.groups) < len(sizes) / 2 and all(np.prod(s) <= CODES for s in packing.sizes)
    feature = rng.integers(0, len(sizes), 15)
    cut = np.array([BINS if i == 2 else rng.integers(0, sizes[f]) for i, f in enumerate(feature)])
    codes = packing.codes(bins)
    for depth in range(4):
        node = walk(bins, feature, cut, depth, np.arange(n))
        assert (packing.walk(codes, feature, cut, depth) == node).all()
        got = packing.sums([(codes, None, None, r)] * 2, feature, cut, depth)
        for c in range(len(sizes)):
            at = (node - ((1 << depth) - 1)) * BINS + bins[c]
            assert (got[0, c].ravel() == 2 * np.bincount(at, minlength=BINS << depth)).all()
            assert np.allclose(got[1, c].ravel(), 2 * np.bincount(at, r, minlength=BINS << depth))


def test_a_small_table_is_boosted_in_few_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [((i, 0), rng.integers(0, 4, (3, 500)).astype(np.uint8), (rng.random(500) < 0.4).astype(np.uint8)) for i in range(8)]
    sc = spark.sparkContext
    blocks = sc.parallelize(rows, 8).persist()
    blocks.count()
    sc.setJobGroup("boost", "boost")
    model = boost(blocks, [np.arange(3.0)] * 3, 2, 2, 0.1)
    told = sc.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup("boost") for s in told.getJobInfo(j).stageIds]
    sc._jsc.clearJobGroup()
    blocks.unpersist()
    assert tasks.count(1) >= 3 and tasks.count(8) <= 1
    y, (c, cut) = np.concatenate([r[2] for r in rows]) * 2.0 - 1, (model.heaps.feature[0, 0], model.heaps.threshold[0, 0])
    low = np.concatenate([r[1][c] for r in rows]) <= cut  # cut k lies behind bin k
    assert abs(model.heaps.value[0, 1] * low.sum() + model.heaps.value[0, 2] * (~low).sum() - y.sum()) < 1e-6 * len(y)


def test_rare_values_keep_a_cut(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 7, F.lit(1.0)).otherwise(F.lit(0.0)).alias("rare"), F.col("id").cast("double").alias("x"), F.lit(2.0).alias("same"))
    rare, x, same = cut_points(df, ["rare", "x", "same"])
    assert rare.tolist() == [0.5] and len(x) == BINS - 1 and not len(same)


def test_boosting_fits_like_mllib_and_outlives_its_session(spark, train, tmp_path):
    from pyspark.ml.classification import GBTClassifier
    ours = fit_boosting(train, len(STD_COLS), 12, 3, 0.1)
    mllib = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1, seed=1).fit(train)
    y = F.col("label")

    def loss(model):
        p = vector_to_array("probability")[1]
        return -model.transform(train).agg(F.avg(F.log(F.when(y == 1, p).otherwise(1 - p)))).first()[0]
    assert loss(ours) < 1.03 * loss(mllib)
    path = str(tmp_path / "boosting")
    ours.write().save(path)
    again = BoostedTrees.load(path)
    pick = lambda m: [r["m"] for r in train.select(m.margin([F.col(c) for c in STD_COLS]).alias("m")).collect()]
    assert pick(ours) == pick(again) and ours.weights.tolist() == [1.0] + [0.1] * 11
    with pytest.raises(Exception):
        ours.write().save(path)
