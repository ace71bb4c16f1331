"""Distributed ranks, codes and quantiles against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanframe.functions import short_number
from loanframe.operators import ranks


def skewed(spark, n, seed=1):
    """A third of the rows share one score, the others are heavily tied."""
    x = F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.round(F.rand(seed), 3))
    return spark.range(n, numPartitions=7).select(x.alias("s"), (F.rand(seed + 1) < 0.2 + 0.5 * x).cast("int").alias("y")).persist()


def test_auc_with_heavy_ties(spark):
    df = skewed(spark, 20_000)
    rows = np.array([(r["s"], r["y"]) for r in df.collect()])
    pos, neg = rows[rows[:, 1] == 1, 0], rows[rows[:, 1] == 0, 0]
    wins = sum((p > neg).sum() + (p == neg).sum() / 2 for p in pos)
    assert ranks.auc(df, "s", "y").first()["auc"] == round(wins / len(pos) / len(neg), 4)
    assert ranks.auc(df.where("y = 1"), "s", "y").first()["auc"] == 0.0
    assert ranks.auc(df.where("y = 7"), "s", "y").first()["auc"] == 0.0


def test_average_ranks(spark):
    df = skewed(spark, 5_000)
    x = np.sort([r["s"] for r in df.collect()])
    got = {r["score"]: (r["n"], r["rank"]) for r in ranks.average_ranks(df, "s").collect()}
    values, first, n = np.unique(x, return_index=True, return_counts=True)
    assert got == {v: (k, a + (k + 1) / 2) for v, a, k in zip(values.tolist(), first.tolist(), n.tolist())}


@pytest.mark.parametrize("n", [1, 2, 1000, 300_000])
def test_quantiles_equal_numpy(spark, n):
    df = spark.range(n, numPartitions=5).select((F.exp(F.randn(3) * 4) - F.when(F.col("id") % 4 == 0, F.lit(1e6)).otherwise(F.lit(0.0))).alias("s")).persist()
    x = np.array([r["s"] for r in df.collect()])
    for share in (0.0, 0.13, 0.25, 0.5, 0.9871, 1.0):
        for bins in (2, ranks.BINS) if n <= 1000 else (ranks.BINS,):
            assert ranks.quantile(df, "s", share, bins) == np.quantile(x, share)


def test_many_quantiles_take_the_passes_of_one(spark):
    df = skewed(spark, 30_000)
    x = np.array([r["s"] for r in df.collect()])
    shares, tracker = [0.0, 0.13, 0.5, 0.501, 0.9871, 1.0], spark.sparkContext.statusTracker()

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return run(), len(tracker.getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    for bins in (2, 16):
        one, least = jobs(f"one-{bins}", lambda: ranks.quantiles(df, "s", [0.5], bins))
        got, n = jobs(f"all-{bins}", lambda: ranks.quantiles(df, "s", shares, bins))
        assert got == [np.quantile(x, s) for s in shares] and one == [np.quantile(x, 0.5)]
        assert n <= 2 * least


def test_codes_of_a_million_values(spark):
    df = spark.range(2_000_000, numPartitions=8).select(F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(1_000_000)).cast("string")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None,)], "v string"))
    codes = ranks.dense_codes(df, "v").persist()
    stats = codes.agg(F.count(F.lit(1)).alias("n"), F.min("code"), F.max("code"), F.countDistinct("code")).first()
    assert tuple(stats) == (1_000_000, 0, 999_999, 1_000_000)
    some = sorted(r["value"] for r in codes.select("value").collect())
    pick = {r["value"]: r["code"] for r in codes.where("code % 99991 = 0 or code = 5").collect()}
    assert pick and all(some[c] == v for v, c in pick.items())


def test_short_numbers(spark):
    cases = {0.0: "0.0", 0.25: "0.3", 0.35: "0.3", 1.15: "1.1", 12.35: "12.3", 999.95: "1000.0", 1000.0: "1K", 1500.0: "2K", 2499.9: "2K",
             99_999.0: "100K", 100_000.0: "1.0L", 1_250_000.0: "12.5L", 1e7: "1.0Cr", -45_000.0: "-45K", -2.5e7: "-2.5Cr", -0.04: "-0.0",
             float("nan"): "0"}
    got = spark.createDataFrame([(k,) for k in cases], "x double").select("x", short_number("x").alias("t")).collect()
    assert [r["t"] for r in got] == list(cases.values())
    assert spark.range(1).select(short_number(F.lit(None)).alias("t")).first()["t"] == "0"


def test_a_scope_removes_its_tables(spark, tmp_path):
    import os
    from loanframe.session import scratch
    df = skewed(spark, 2_000)
    with scratch(spark) as base:
        ranks.average_ranks(df, "s").write.parquet(str(tmp_path / "ranks"))
        assert any(os.scandir(base))
        with scratch(spark) as inner:
            assert ranks.dense_codes(df, "s").count() and os.path.exists(inner)
        assert not os.path.exists(inner) and os.path.exists(base)
    assert not os.path.exists(base) and spark.read.parquet(str(tmp_path / "ranks")).count() > 100
