"""Column helpers: rounding, money text, hash uniforms."""

import numpy as np
from pyspark.sql import functions as F

from loanframe.functions import hash_uniform, inr_format, rnd


def test_rnd_matches_numpy(spark):
    vals = [0.125, 0.375, 2.675, 1.005, -0.5, 12.345, 1e-9, 123456.785]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(rnd("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_inr_format(spark):
    vals = [(12345678,), (9999999,), (150000,), (99999,), (500,), (499,), (-250000,), (10050000,)]
    df = spark.createDataFrame(vals, "v bigint")
    got = [r[0] for r in df.select(inr_format("v")).collect()]
    assert got == ["₹1.2Cr", "₹100.0L", "₹1.5L", "₹100K", "₹1K", "₹0K", "₹-250K", "₹1.0Cr"]


def test_hash_uniform_range_and_determinism(spark):
    a = spark.range(0, 5000, numPartitions=3).select("id", hash_uniform("id", seed=7).alias("u"))
    b = spark.range(0, 5000, numPartitions=11).select("id", hash_uniform("id", seed=7).alias("u"))
    ra, rb = dict(a.collect()), dict(b.collect())
    assert ra == rb
    u = np.array(list(ra.values()))
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert a.agg(F.countDistinct("u")).first()[0] == 5000
