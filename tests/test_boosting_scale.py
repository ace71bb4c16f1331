"""Boosting's sums by sides, cut points from summaries, and the thresholds of the walk."""

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import functions as F

from loanframe.models import boosting
from loanframe.models.boosting import BINS, KEPT, Packing, both_sides, cut_points
from loanframe.models.features import STD_COLS, VALUES, FeatureEncoder, feature_values
from loanframe.models.heaps import Heaps
from loanframe.plans.catalog import loans


def test_the_larger_child_has_what_is_left_of_its_node():
    rng, n = np.random.default_rng(5), 5000
    sizes = [BINS, BINS, 5, 7, 2]
    bins, r = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8), rng.integers(-8, 9, n) / 8
    packing = Packing([np.arange(s - 1.0) for s in sizes])
    feature = rng.integers(0, len(sizes), 15)
    cut = np.array([rng.integers(0, sizes[f] - 1) for f in feature])
    cut[[2, 5, 6]] = BINS  # not split: all rows on the low side
    codes, level = packing.codes(bins), [None] * 4
    for depth in range(4):
        level[depth] = packing.sums([(codes, None, None, r)], feature, cut, depth)
        if depth:
            side = rng.integers(0, 2, 1 << (depth - 1))
            part = packing.sums([(codes, None, None, r)], feature, cut, depth, side)
            assert part[0, 0].sum() < n and (both_sides(level[depth - 1], part, side) == level[depth]).all()


def test_cut_points_are_quantiles_however_the_rows_are_dealt(spark, monkeypatch):
    """Far more rows than a summary tells of, in summaries of some thousand rows: ranks stay within a few thousandths."""
    monkeypatch.setattr(boosting, "SORTED", 10_000)
    monkeypatch.setattr(boosting, "POINTS", 200)
    df = spark.range(0, 300_000, 1, 7).select(((F.col("id") * 7919) % 300_007).cast("double").alias("x"),
                                              F.pow(F.col("id") / 1e4, 3).alias("y"), (F.col("id") % 32).cast("double").alias("few"))
    x, y, few = cut_points(df, ["x", "y", "few"])
    assert few.tolist() == [k + 0.5 for k in range(31)] and len(x) == len(y) == BINS - 1
    for cuts, c in ((x, "x"), (y, "y")):
        below = df.agg(*[F.avg((F.col(c) <= F.lit(float(q))).cast("double")) for q in cuts]).first()
        assert max(abs(share - (k + 1) / BINS) for k, share in enumerate(below)) < 0.006
    told = df.select("x").where("x < 2000")
    assert cut_points(told.unionByName(told).repartition(3), ["x"])[0].tolist() == cut_points(told, ["x"])[0].tolist()


def test_the_walk_over_places_is_the_walk_over_values():
    rng = np.random.default_rng(6)
    for depth, most in ((2, 3), (5, 300), (7, 70_000)):
        trees, nodes = 5, (2 << depth) - 1
        feature, value = rng.integers(0, 4, (trees, nodes)), rng.normal(size=(trees, nodes))
        threshold = rng.choice(rng.normal(size=most), (trees, nodes))
        x = rng.choice(np.concatenate([threshold.ravel(), rng.normal(size=500), [np.nan, np.inf, -np.inf]]), (700, 4))
        want = np.zeros(len(x))
        for f, t, v in zip(feature, threshold, value):
            for i, row in enumerate(x):
                node = 0
                for _ in range(depth):
                    node = 2 * node + (1 if row[f[node]] <= t[node] else 2)
                want[i] += v[node]
        assert (Heaps(feature, threshold, value).total(x) == want).all()


def test_the_training_table_holds_plain_arrays(spark, monkeypatch):
    """Each pass of a learner would convert a vector anew; the blocks are kept as the bytes that go to Python."""
    from loanframe.models.bundle import LoanModels
    seen = []
    monkeypatch.setattr(LoanModels, "_fit_learners", lambda self, train, *_: seen.append(
        (train.columns, [list(r) for r in train.orderBy("loan_id").select(feature_values(train)).limit(5).toPandas().iloc[:, 0]])))
    base = loans(spark, "/root/testdata/sf0.001")
    LoanModels.fit(base)
    (columns, values), = seen
    assert VALUES in columns and "features" not in columns
    want = FeatureEncoder.fit(base).standardized(base).orderBy("loan_id").select(*STD_COLS).limit(5).collect()
    assert np.allclose(values, [list(r) for r in want])
    assert KEPT == StorageLevel.MEMORY_AND_DISK_DESER
