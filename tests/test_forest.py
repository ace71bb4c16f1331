"""The histogram forest against plain NumPy, MLlib and itself."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanframe.models.boosting import BINS, binned
from loanframe.models.features import STD_COLS, FeatureEncoder
from loanframe.models.forest import POISSON, BaggedTrees, _histograms, candidates, draws, fit_forest
from loanframe.plans.catalog import loans


@pytest.fixture(scope="module")
def train(spark):
    base = loans(spark, "/root/testdata/sf0.001")
    return FeatureEncoder.fit(base).transform(base).withColumn("label", F.col("default_indicator").cast("double")).persist()


def test_draws_are_poisson_and_repeatable():
    drawn = draws(1, 5, (0, 2), 50_000)
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01
    assert (drawn == draws(1, 5, (0, 2), 50_000)).all() and (drawn != draws(1, 5, (0, 3), 50_000)).any()
    assert abs(POISSON.mean() - 1) < 1e-3


def test_histograms_are_plain_sums():
    rng = np.random.default_rng(2)
    blocks = [((0, i), rng.integers(0, BINS, (5, 700)).astype(np.uint8), (rng.random(700) < 0.3).astype(np.uint8)) for i in range(2)]
    feature, cut = np.array([[2, 0, 0]] * 3, np.int16), np.array([[9, BINS, BINS]] * 3, np.int16)
    got = dict(_histograms(feature, cut, 1, 5, 2, 7)(iter(blocks)))
    want = np.zeros((2, 2, 2, BINS))
    for block, bins, label in blocks:
        for row, (w, y) in enumerate(zip(draws(7, 1, block, 700), label)):
            node = int(bins[2, row] > 9)
            for j, c in enumerate(candidates(7, 1, 1, 5, 2)[node]):
                want[0, j, node, bins[c, row]] += w
                want[1, j, node, bins[c, row]] += int(w) * int(y)
    assert (got[1] == want).all() and set(got) == {0, 1, 2}


def test_forest_separates_like_mllib_and_outlives_its_session(spark, train, tmp_path):
    """Far fewer jobs than trees, no worse a loss than MLlib's forest, and no part of it is random from run to run."""
    from pyspark.ml.classification import RandomForestClassifier
    blocks, cuts = binned(train, len(STD_COLS))
    spark.sparkContext.setJobGroup("forest", "forest")
    ours = fit_forest(blocks, cuts, 30, 6, 3, 42)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 6
    spark.sparkContext._jsc.clearJobGroup()
    mllib = RandomForestClassifier(numTrees=30, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=1).fit(train)

    def loss(model):
        p = F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), vector_to_array("probability")[1]))
        return -model.transform(train).agg(F.avg(F.log(F.when(F.col("label") == 1, p).otherwise(1 - p)))).first()[0]
    assert loss(ours) < 1.03 * loss(mllib)
    assert abs(ours.importances.sum() - 1) < 1e-9 and len(ours.importances) == len(STD_COLS)
    again = fit_forest(blocks, cuts, 30, 6, 3, 42)
    assert (ours.heaps.threshold == again.heaps.threshold).all() and (ours.heaps.value == again.heaps.value).all()
    blocks.unpersist()
    ours.write().save(str(tmp_path / "forest"))
    loaded = BaggedTrees.load(str(tmp_path / "forest"))
    pick = lambda m: [r["p"] for r in train.select(m.probability([F.col(c) for c in STD_COLS]).alias("p")).collect()]
    p = pick(ours)
    assert p == pick(loaded) and 0 <= min(p) and max(p) <= 1 + 1e-12
