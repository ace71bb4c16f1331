"""K-means over blocks against MLlib's and a plain pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanframe.models.features import STD_COLS, FeatureEncoder
from loanframe.models.segments import Segments, _sums, fit_segments, nearest
from loanframe.plans.catalog import loans


def test_a_pass_adds_up_the_rows_nearest_to_each_centre():
    rng = np.random.default_rng(0)
    x, centres = rng.normal(size=(3, 500)).astype(np.float32), rng.normal(size=(4, 3))
    d = ((x.T[:, None] - centres) ** 2).sum(2)
    at, best = nearest(x.astype(float), centres)
    assert (at == d.argmin(1)).all() and np.allclose(best, d.min(1))
    (sums, cost), = _sums(centres)(iter([x[:, :200], x[:, 200:]]))
    assert sums[:, 0].tolist() == np.bincount(at, minlength=4).tolist() and np.allclose(cost, d.min(1).sum())
    assert np.allclose(sums[:, 1:], [x.T[at == k].sum(0, dtype=float) for k in range(4)])
    assert nearest(np.zeros((3, 2)), np.ones((2, 3)))[0].tolist() == [0, 0]  # ties to the first


def test_segments_fit_like_mllib_and_outlive_their_session(spark, tmp_path):
    from pyspark.ml.clustering import KMeans
    base = loans(spark, "/root/testdata/sf0.001")
    train = FeatureEncoder.fit(base).transform(base).persist()
    ours = fit_segments(train, STD_COLS, 4, 42)
    mllib = KMeans(k=4, seed=42, predictionCol="c").fit(train)
    cost = train.agg(F.sum(F.least(*ours.distances()))).first()[0]
    assert len(ours.centres) == 4 and cost < 1.1 * mllib.summary.trainingCost
    assert fit_segments(train, STD_COLS, 4, 42) == ours
    pick = lambda m: train.select("loan_id", m.cluster().alias("c")).groupBy("c").count().collect()
    assert sorted(r["c"] for r in pick(ours)) == [0, 1, 2, 3]
    ours.write().save(str(tmp_path / "segments"))
    assert Segments.load(str(tmp_path / "segments")) == ours
    with pytest.raises(Exception):
        ours.write().save(str(tmp_path / "segments"))
    train.unpersist()


def test_fewer_rows_than_centres(spark):
    from pyspark.ml.linalg import Vectors
    few = spark.createDataFrame([(Vectors.dense([0.0, 1.0]),), (Vectors.dense([0.0, 1.0]),), (Vectors.dense([5.0, 1.0]),)], ["features"])
    assert sorted(fit_segments(few, ["a", "b"], 4, 1).centres) == [(0.0, 1.0), (5.0, 1.0)]
