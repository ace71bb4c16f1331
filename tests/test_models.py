"""Model invariants (rows-only queries carry their weight here)."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanframe import constants as K
from loanframe.models.bundle import LoanModels, anomaly_scores, predict_loans
from loanframe.models.features import hyperparams
from loanframe.operators import scoring as S
from loanframe.models.isoforest import avg_path_length, grow_tree
from loanframe.plans.catalog import fitted_models, loans
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def models(spark):
    return fitted_models(spark, SF_SMALL)


def test_hyperparams_small_n():
    h1, h5, big = hyperparams(1), hyperparams(5), hyperparams(100000)
    assert (h1.rf_trees, h1.rf_depth, h1.rf_min_leaf, h1.gb_trees, h1.gb_depth, h1.kmeans_k) == (10, 2, 1, 10, 2, 1)
    assert (h5.rf_trees, h5.rf_depth, h5.rf_min_leaf, h5.gb_trees, h5.gb_depth, h5.kmeans_k) == (25, 2, 1, 15, 2, 4)
    assert (big.rf_trees, big.rf_depth, big.rf_min_leaf, big.gb_trees, big.gb_depth, big.lr_c) == (120, 8, 3, 80, 4, 1.0)


def test_train_quality(models):
    assert models.auc > 0.6
    assert len(models.importances) == 10
    assert abs(sum(v for _, v in models.importances)) <= 1.0001
    assert models.iso is not None and models.kmeans is not None and models.grade_lr is not None


def test_ensemble_is_weighted_blend(spark, models):
    feat = models.featurize(loans(spark, SF_SMALL)).limit(200)
    rf = models.rf.setProbabilityCol("p1").setRawPredictionCol("r1").setPredictionCol("q1")
    gb = models.gbt.setProbabilityCol("p2").setRawPredictionCol("r2").setPredictionCol("q2")
    out = gb.transform(rf.transform(feat)).select(
        vector_to_array("p1")[1].alias("a"), vector_to_array("p2")[1].alias("b")).collect()
    ens = models._with_prob(models.featurize(loans(spark, SF_SMALL)).limit(200)).select("_ens").collect()
    for (a, b), (e,) in zip(out, ens):
        assert abs(e - (0.6 * a + 0.4 * b)) <= 0.00005 + 1e-12


def test_scores_in_range_and_clusters(spark, models):
    sc = models.score(loans(spark, SF_SMALL))
    lim = sc.agg(F.min("default_prob"), F.max("default_prob"), F.min("early_warning_score"),
                 F.max("early_warning_score"), F.countDistinct("cluster")).first()
    assert 0 <= lim[0] <= lim[1] <= 1 and 0 <= lim[2] <= lim[3] <= 100 and lim[4] == 4
    assert sc.count() == loans(spark, SF_SMALL).count()


def test_anomaly_offset_is_contamination_quantile(spark, models):
    a = anomaly_scores(models, loans(spark, SF_SMALL).where("loan_status = 'Active'"))
    frac = a.agg(F.avg((F.col("decision") < 0).cast("double"))).first()[0]
    rate = loans(spark, SF_SMALL).agg(F.avg("default_indicator")).first()[0]
    assert abs(frac - min(0.5, max(0.05, rate))) < 0.01


def test_one_split_is_spread_over_the_cores(spark):
    """A table read in one task is fitted and scored by several, with the same rows."""
    from loanframe.session import spread
    one = spark.range(0, 400_000, 1, 1).select("id", *[F.xxhash64("id", F.lit(i)).alias(f"x{i}") for i in range(5)])
    out = spread(one)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) >= 4 and max(per) < 2 * min(per) and sum(per) == 400_000
    assert out.exceptAll(one).count() == 0


def test_single_class_falls_back_to_rules(spark):
    df = loans(spark, SF_SMALL).limit(40).withColumn("default_indicator", F.lit(0))
    m = LoanModels.fit(df, n_trees_iso=10)
    assert m.single_class and m.rf is None
    from loanframe.operators.scoring import score_rules
    a = score_rules(df).select("loan_id", "default_prob", "early_warning_score").orderBy("loan_id").collect()
    b = m.score(df).select("loan_id", "default_prob", "early_warning_score").orderBy("loan_id").collect()
    assert a == b


def test_tiny_tables(spark):
    base = loans(spark, SF_SMALL)
    for n in (2, 3):
        m = LoanModels.fit(base.where("default_indicator = 1").limit(1).unionByName(
            base.where("default_indicator = 0").limit(n - 1)), n_trees_iso=5)
        assert m.iso is None  # below 5 rows no isolation forest
    m1 = LoanModels.fit(base.limit(1), n_trees_iso=5)
    assert m1.kmeans is None and m1.single_class
    assert m1.score(base.limit(1)).first()["cluster"] == 0


def test_predict_unseen_and_missing(spark, models):
    apps = spark.createDataFrame([("X1", 720.0, "Mars", "Personal Loan"), ("X2", 580.0, "Metro", "Nope")],
                                 "loan_id string, credit_score double, geography string, product_type string")
    out = predict_loans(models, apps).collect()
    assert [r["loan_id"] for r in out] == ["X1", "X2"]
    for r in out:
        assert 0 <= r["default_probability"] <= 1 and r["risk_level"] in ("Low", "Medium", "High")
        assert r["early_warning_score"] >= 30 * 0.6  # missing cashflow -> 0 -> +30 base points


def test_isolation_tree_growth():
    import numpy as np
    x = np.random.default_rng(0).normal(size=(256, 3))
    nodes = grow_tree(x, 0, 8, 42)
    leaves = [n for n in nodes if n[2] == -1]
    assert sum(n[6] for n in leaves) == 256 and max(n[7] for n in nodes) <= 8
    assert avg_path_length([0, 1, 2, 256]).round(4).tolist() == [0.0, 0.0, 1.0, round(2 * (np.log(255) + 0.5772156649015329) - 2 * 255 / 256, 4)]
    assert K.CAT_COLS and K.NUM_COLS


def test_isolation_samples_full_and_uniform(spark):
    """Each tree gets exactly psi distinct rows, also with the per-row gate
    active (10 trees over 15 000 rows: gate probability ~0.27), and the
    samples are not biased (mean credit score near the table's)."""
    from loanframe.models.isoforest import tree_samples
    base = loans(spark, "/root/testdata/sf0.01").select("loan_id", F.col("credit_score").cast("double").alias("x"))
    n = base.count()
    s = tree_samples(base, ["x"], "loan_id", n, n_trees=10, psi=256, seed=7)
    per = {r["tree"]: (r["rows"], r["ids"], r["mx"]) for r in s.groupBy("tree").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("loan_id").alias("ids"), F.avg("x").alias("mx")).collect()}
    assert sorted(per) == list(range(10))
    assert all(rows == ids == 256 for rows, ids, _ in per.values())
    pop = base.agg(F.avg("x"), F.stddev_pop("x")).first()
    pooled = sum(mx for _, _, mx in per.values()) / 10
    assert abs(pooled - pop[0]) < 4 * pop[1] / (2560 ** 0.5)


def test_isolation_samples_with_null_or_repeated_ids(spark):
    from loanframe.models.isoforest import tree_samples
    base = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit("same")).alias("loan_id"), F.col("id").cast("double").alias("x"))
    per = tree_samples(base, ["x"], "loan_id", 60_000, n_trees=20, psi=256).groupBy("tree").agg(F.countDistinct("x").alias("n")).collect()
    assert sorted(r["tree"] for r in per) == list(range(20)) and {r["n"] for r in per} == {256}


def test_guard_looks_at_the_scored_table(spark, models):
    """A table whose loans are all alike gets the rule PD, whatever the training spread."""
    one = loans(spark, SF_SMALL).limit(1)
    alike = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    got = {r["default_prob"] for r in models.score(alike).collect()}
    assert got == {r["p"] for r in one.select(S.rule_default_prob().alias("p")).collect()}
    ens = {r["_ens"] for r in models._with_prob(models.featurize(alike)).collect()}
    assert {r["default_prob"] for r in models.score(alike, guard=False).collect()} == ens
    got = {r["default_probability"] for r in predict_loans(models, alike).collect()}
    assert got == ens


def test_forest_alone(spark):
    m = LoanModels.fit(loans(spark, SF_SMALL).limit(300), n_trees_iso=5, boosting=False)
    assert m.gbt is None and m.rf is not None
    r = m._with_prob(m.featurize(loans(spark, SF_SMALL).limit(50)), keep_rf="_p").collect()
    assert all(abs(x["_ens"] - x["_p"]) < 5.1e-5 for x in r)


def test_scoring_leaves_the_models_as_they_are(spark, models):
    before = models.rf.getProbabilityCol()
    models.score(loans(spark, SF_SMALL).limit(20)).count()
    assert models.rf.getProbabilityCol() == before


def test_isolation_forest_trains_on_all_when_few_are_active(spark):
    df = loans(spark, SF_SMALL).limit(60).withColumn("loan_status", F.when(F.col("loan_id").isNull(), "Active").otherwise("Default"))
    m = LoanModels.fit(df, n_trees_iso=5)
    assert m.iso is not None and m.iso.psi == 60


def test_compiled_trees_score_like_the_fitted_ones(spark):
    """The expressions read from fitted learners give the learners' probabilities, clusters and grades."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from loanframe.models.compiled import centres_of, multinomial_of, trees_of
    from loanframe.models.features import STD_COLS, FeatureEncoder
    base = loans(spark, SF_SMALL)
    feat = FeatureEncoder.fit(base).transform(base).withColumn("label", F.col("default_indicator").cast("double"))
    feat = feat.withColumn("y", F.pmod(F.xxhash64("credit_quality"), F.lit(3)).cast("double")).persist()
    rf = RandomForestClassifier(numTrees=8, maxDepth=4, seed=1).fit(feat)
    gb = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(feat)
    for model in (rf, gb):
        out = model.transform(feat).select(vector_to_array("probability")[1].alias("p"), trees_of(model, STD_COLS).probability().alias("q"))
        assert out.where(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    km = KMeans(k=4, seed=1, predictionCol="c").fit(feat)
    lr = LogisticRegression(labelCol="y", family="multinomial", maxIter=30).fit(feat)
    out = lr.transform(km.transform(feat)).withColumn("c2", centres_of(km, STD_COLS).cluster()).withColumn("y2", multinomial_of(lr, STD_COLS).label())
    assert out.where("c <> c2 or prediction <> y2").count() == 0
    feat.unpersist()


def test_ties_go_to_the_smallest_number(spark):
    from loanframe.models.compiled import Centres, Multinomial
    one = spark.createDataFrame([(0.0,), (3.0,)], "x double")
    centres = Centres(("x",), ((5.0,), (1.0,), (-1.0,), (1.0,)))
    model = Multinomial(("x",), ((0.0,), (1.0,), (1.0,)), (0.0, 0.0, 0.0))
    assert [tuple(r) for r in one.select(centres.cluster(), model.label()).collect()] == [(1, 0), (0, 1)]


def test_a_saved_bundle_scores_the_same(spark, models, tmp_path):
    path = str(tmp_path / "bundle")
    models.save(spark, path)
    again = LoanModels.load(spark, path)
    df = loans(spark, SF_SMALL).withColumn("geography", F.when(F.col("loan_id") < "LN-000100", "Mars").otherwise(F.col("geography")))
    pick = lambda m: sorted(tuple(r) for r in m.score_all(df).select(
        "loan_id", "default_prob", "early_warning_score", "cluster", "decision", "predicted_grade").collect())
    assert pick(models) == pick(again)
    assert (again.auc, again.n, again.importances, again.hyper) == (models.auc, models.n, models.importances, models.hyper)
    with pytest.raises(Exception):
        models.save(spark, path)
    models.save(spark, path, overwrite=True)
    from loanframe.models.fixed import fixed_models
    with pytest.raises(TypeError):
        fixed_models().save(spark, str(tmp_path / "other"))


def test_a_loaded_bundle_scores_a_stream(spark, models, tmp_path):
    from loanframe.streaming.scoring import read_loan_stream, run_available_now, score_stream
    models.save(spark, str(tmp_path / "bundle"))
    df = loans(spark, SF_SMALL).limit(200)
    df.write.parquet(str(tmp_path / "in"))
    again = LoanModels.load(spark, str(tmp_path / "bundle"))
    out = run_available_now(score_stream(read_loan_stream(spark, str(tmp_path / "in"), df.schema), again), str(tmp_path / "out"))
    got = {r["loan_id"]: r["early_warning_score"] for r in spark.read.parquet(out).collect()}
    landed = spark.read.parquet(str(tmp_path / "in"))
    assert got == {r["loan_id"]: r["early_warning_score"] for r in models.score(landed, guard=False).collect()}


def test_categories_beyond_the_driver_are_joined(spark):
    """With no labels on the driver the features are the same, unseen and missing values included."""
    from loanframe.models.features import FEATURE_NAMES, FeatureEncoder
    base = loans(spark, SF_SMALL)
    few, many = FeatureEncoder.fit(base), FeatureEncoder.fit(base, max_labels=0)
    assert not few.codes and set(many.codes) == set(K.CAT_COLS) and many.indexer is None
    odd = base.limit(50).withColumn("geography", F.when(F.col("loan_id") < "LN-000300", "Mars").when(F.col("loan_id") < "LN-000600", F.lit(None))
                                    .otherwise(F.col("geography")))
    pick = lambda e: sorted(tuple(r) for r in e._raw(odd).select("loan_id", *FEATURE_NAMES).collect())
    assert pick(few) == pick(many)


def test_training_partitions_follow_the_rows_not_the_shuffle_setting(spark, monkeypatch):
    from loanframe.models import bundle
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(LoanModels, "_fit_learners", lambda self, train, *_: seen.append((train.rdd.getNumPartitions(), train.count())))
    spark.conf.set("spark.sql.shuffle.partitions", "57")
    try:
        m = LoanModels.fit(loans(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(cores, m.n)] and cores != 57
    assert bundle.fit_partitions(spark, 1000 * cores * bundle.PART_ROWS + 1) == 1000 * cores + 1
