"""The fitted model bundle (M3, M4, M7-M10) and ML-mode scoring.

``LoanModels.fit(loans)`` trains, on the whole table:

* default model: random forest (:mod:`forest`) + gradient-boosted trees (:mod:`boosting`),
  blended 0.6 / 0.4 -- skipped when the label has a single class, in which case
  scoring falls back to the rule scores;
* isolation forest (custom, see :mod:`isoforest`) for the early-warning bonus;
* k-means segments;
* a multinomial logistic grade classifier.

Fitting takes a handful of actions (row/class counts, feature statistics,
the learners' own jobs); scoring is a lazy projection (``model.transform``
plus column expressions and two Arrow UDFs) that never shuffles, so it
applies unchanged to batch or streaming input.

The probability-spread guard (R5) is evaluated on the table being scored: the
scored table is written once, the spread read from that one column of it, and the
default probability is then chosen among the written columns.  A stream has no
table, so there the spread over the training rows counts.

A bundle outlives its session: ``save`` writes every part to a folder of any
store that Spark writes, ``load`` gives a bundle that scores the same.  Its parts
may also be native expressions (:mod:`compiled`) in place of MLlib models.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clip, risk_level, rnd
from ..operators import scoring as S
from ..operators.ranks import auc
from ..session import ensure_checkpoint_dir, materialize
from .boosting import BoostedTrees, binned, boost
from .compiled import Boosting, Forest, Multinomial, multinomial_of
from .features import FEATURE_NAMES, STD_COLS, VALUES, FeatureEncoder, Hyper, feature_values, hyperparams
from .forest import BaggedTrees, fit_forest
from .isoforest import IsolationForestModel, fit_isolation_forest
from .segments import Segments, fit_segments

SEED = 42
PART_ROWS = 1 << 18  # rows of the training table in a partition, unless that leaves cores idle


def _bare(model):
    """The model without its training summary, which holds the training table and the session in every closure that
    scores with it."""
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def fit_partitions(spark: SparkSession, n: int) -> int:
    """Partitions of a training table of ``n`` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))


def isolation_rows(train: DataFrame, active: int) -> DataFrame:
    """the rows that the isolation forest learns from: the active ones, or all when fewer than three are."""
    return train.where(F.col("loan_status") == "Active") if active >= 3 else train


def together(wanted: dict) -> dict:
    """The results of some actions, run side by side."""
    with ThreadPoolExecutor(max(1, len(wanted))) as pool:
        running = {k: pool.submit(inheritable_thread_target(SparkSession.active())(fn)) for k, fn in wanted.items()}
        return {k: f.result() for k, f in running.items()}


@dataclass
class LoanModels:
    encoder: FeatureEncoder
    hyper: Hyper
    n: int
    single_class: bool
    rf: object | None = None
    gbt: object | None = None
    iso: IsolationForestModel | None = None
    kmeans: object | None = None
    grade_lr: object | None = None
    grade_labels: list[str] = field(default_factory=list)
    prob_std: float | None = None
    auc: float = 0.0
    importances: list[tuple[str, float]] = field(default_factory=list)

    # ------------------------------------------------------------------ fit
    @staticmethod
    def fit(loans: DataFrame, n_trees_iso: int = 100, boosting: bool = True) -> "LoanModels":
        """``boosting=False`` fits the forest alone; the ensemble is then the forest's probability."""
        spark = loans.sparkSession
        # The binned rows, and boosting's margins every few trees, are checkpointed
        # into the shared folder named by spark.checkpoint.dir, so a lost executor
        # recomputes at most those trees instead of the whole chain.
        ensure_checkpoint_dir(spark)
        # Only the model inputs are kept: one narrow projection of the loans,
        # persisted, so the statistics, the encoder and the training table
        # read it instead of re-deriving the loans for every pass.
        keep = ["loan_id", "default_indicator", "loan_status", *K.CAT_COLS, *K.NUM_COLS]
        base = loans.select(*[c for c in dict.fromkeys(keep) if c in loans.columns]).persist()
        train = None
        try:
            # Two classes or grades are told by min and max: no distinct counting over the loans.
            grade = F.col("credit_quality").cast("string")
            stats = base.agg(F.count(F.lit(1)).alias("n"),
                             (F.min("default_indicator") != F.max("default_indicator")).alias("classes"),
                             F.avg(F.col("default_indicator").cast("double")).alias("rate"),
                             F.count_if(F.col("loan_status") == "Active").alias("active"),
                             (F.min(grade) != F.max(grade)).alias("grades")).first()
            n = int(stats["n"])
            if n == 0:
                raise ValueError("cannot fit models on an empty table")
            hp = hyperparams(n)
            enc = FeatureEncoder.fit(base)
            m = LoanModels(encoder=enc, hyper=hp, n=n, single_class=not stats["classes"])

            # One copy of each feature: an array, which all learners read as it is, but the multinomial one, which makes
            # its vectors once.
            train = enc.standardized(base).select(
                "loan_id", "loan_status", "credit_quality", F.col("default_indicator").cast("double").alias("label"),
                F.array(*STD_COLS).alias(VALUES), F.xxhash64(*STD_COLS).alias("_dealt"))
            # Even partitions for the learners' many passes, at every size. Their number follows the rows, not the
            # session's shuffle setting, which a persisted table keeps: some hundred passes start a task for each.
            train = train.repartition(fit_partitions(spark, n), "loan_id", "_dealt").drop("_dealt").persist()
            train.count()
            base.unpersist()
            m._fit_learners(train, stats, n_trees_iso, boosting)
        finally:
            if train is not None:
                train.unpersist()
            base.unpersist()
        return m

    def _fit_learners(self, train: DataFrame, stats, n_trees_iso: int, boosting: bool) -> None:
        hp, n = self.hyper, self.n

        def fit_rf():
            return fit_forest(*blocks, hp.rf_trees, hp.rf_depth, hp.rf_min_leaf, SEED)

        def fit_gbt():
            return boost(*blocks, hp.gb_trees, hp.gb_depth, 0.1)

        def fit_iso():
            rate = float(stats["rate"] or 0.0)
            contamination = min(0.5, max(0.05, rate or 0.12))
            active = int(stats["active"])
            iso_train = isolation_rows(train, active)
            iso_train = iso_train.select("loan_id", *[F.col(VALUES)[i].alias(c) for i, c in enumerate(STD_COLS)])
            return fit_isolation_forest(iso_train, STD_COLS, "loan_id", active if active >= 3 else n,
                                        contamination, n_trees=n_trees_iso, seed=SEED)

        def fit_kmeans():
            return fit_segments(train, STD_COLS, hp.kmeans_k, SEED)

        def fit_grade():
            with_s = train.select(F.col("credit_quality").cast("string").alias("_grade_s"), array_to_vector(VALUES).alias("features"))
            gi = StringIndexer(inputCol="_grade_s", outputCol="_grade_y", stringOrderType="alphabetAsc").fit(with_s)
            lr = LogisticRegression(
                featuresCol="features", labelCol="_grade_y", family="multinomial", maxIter=500,
                regParam=1.0 / (hp.lr_c * n), elasticNetParam=0.0, standardization=False, tol=1e-4,
                predictionCol="_grade_pred", probabilityCol="_grade_prob",
                rawPredictionCol="_grade_raw").fit(gi.transform(with_s))
            return list(gi.labels), _bare(lr)

        wanted, blocks = {}, None
        if not self.single_class:
            blocks = binned(train, len(STD_COLS))
            wanted["rf"] = fit_rf
            if boosting:
                wanted["gbt"] = fit_gbt
        if n >= 5:
            wanted["iso"] = fit_iso
        if hp.kmeans_k >= 2:
            wanted["kmeans"] = fit_kmeans
        if stats["grades"]:
            wanted["grade"] = fit_grade
        try:
            # The trees and k-means one after another: side by side with the others their many small jobs wait for slots
            # that wide stages hold, and each keeps its own copy of the rows. The others fill each other's gaps.
            done = {k: wanted.pop(k)() for k in ("rf", "gbt") if k in wanted}
            if blocks:
                blocks[0].unpersist()
            done |= {k: wanted.pop(k)() for k in ("kmeans",) if k in wanted}
            done |= together(wanted)
        finally:
            if blocks:
                blocks[0].unpersist()
        self.rf, self.gbt = done.get("rf"), done.get("gbt")
        self.iso, self.kmeans = done.get("iso"), done.get("kmeans")
        if "grade" in done:
            self.grade_labels, self.grade_lr = done["grade"]
        if self.single_class:
            return
        # One scoring pass over the training rows serves both the in-sample
        # forest AUC and the spread of the ensemble probability.
        probs = self._with_prob(train, keep_rf="_p").select("label", "_p", "_ens").persist()
        try:
            self.auc = float(auc(probs, "_p", "label").first()["auc"])
            self.prob_std = float(probs.agg(F.stddev_pop("_ens")).first()[0] or 0.0)
        finally:
            probs.unpersist()
        ranked = sorted(zip(FEATURE_NAMES, self.rf.importances), key=lambda t: -t[1])[:10]
        self.importances = [(name, round(float(v), 4)) for name, v in ranked]

    # -------------------------------------------------------------- scoring
    def _with_prob(self, featurized: DataFrame, keep_rf: str | None = None) -> DataFrame:
        """Ensemble probability ``_ens`` = R(.6 RF + .4 GBT, 4), or the
        forest's alone when there is no boosting; ``keep_rf`` names a column
        that keeps the forest's own probability."""
        out, p = featurized, {}
        for name, model in (("rf", self.rf), ("gb", self.gbt)):
            if isinstance(model, (Forest, Boosting)):
                p[name] = model.probability()
            elif isinstance(model, BoostedTrees):
                if STD_COLS[0] in out.columns:
                    p[name] = model.probability([F.col(c) for c in STD_COLS])
                else:
                    p[name] = model.probability([feature_values(out)[i] for i in range(len(STD_COLS))])
            elif model is not None:
                # A copy with its own output columns: the fitted model is shared between calls.
                own = model.copy({model.probabilityCol: f"_{name}_prob", model.rawPredictionCol: f"_{name}_raw",
                                  model.predictionCol: f"_{name}_pred"})
                out, p[name] = own.transform(out), vector_to_array(F.col(f"_{name}_prob")).getItem(1)
        blend = p["rf"] if "gb" not in p else p["rf"] * F.lit(K.RF_WEIGHT) + p["gb"] * F.lit(K.GB_WEIGHT)
        out = out.withColumn("_ens", rnd(blend, 4))
        if keep_rf:
            out = out.withColumn(keep_rf, p["rf"])
        return out.drop(*[f"_{name}_{x}" for name in p for x in ("prob", "raw", "pred")])

    def featurize(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df)

    def _anomaly_bonus(self, feat: DataFrame) -> DataFrame:
        if self.iso is None:
            return feat.withColumn("_bonus", F.lit(None).cast("double"))
        d = self.iso.decision_column(STD_COLS)
        return feat.withColumn("_decision", d).withColumn(
            "_bonus", clip(-F.col("_decision"), 0.0, 1.0) * F.lit(10.0))

    def uses_rules(self) -> bool:
        return self.single_class

    def _outputs(self, df: DataFrame) -> DataFrame:
        """Input columns, every model output and the features, in one projection chain (nothing is written)."""
        feat = self.featurize(df)
        if self.uses_rules():
            none = F.lit(None).cast("double")
            out = S.score_rules(feat).drop("cluster").withColumnsRenamed(
                {"default_prob": "_rule", "early_warning_score": "_ew"}).withColumns({"_ens": none, "_decision": none})
        else:
            feat = self._anomaly_bonus(self._with_prob(feat))
            bonus = None if self.iso is None else F.col("_bonus")
            out = feat.withColumns({"_rule": S.rule_default_prob(), "_ew": S.ew_blend(F.col("_ens"), bonus)})
            if self.iso is None:
                out = out.withColumn("_decision", F.lit(None).cast("double"))
        return self.assign_clusters(out)

    def _written(self, out: DataFrame) -> tuple[DataFrame, bool]:
        """R5 on the table being scored: (the table, written once, whether its probabilities, that column alone, are
        near-constant)."""
        if out.isStreaming:
            return out, self.prob_std is not None and self.prob_std < K.PROB_STD_FLOOR
        out = materialize(out, "model-scores")
        std = out.agg(F.stddev_pop("_ens")).first()[0]
        return out, std is not None and std < K.PROB_STD_FLOOR

    def _scored(self, out: DataFrame, cols: list[str], guard: bool, extra: tuple[str, ...]) -> DataFrame:
        out, near_constant = out.select(*cols, "_rule", "_ens", "_ew", "cluster", *extra), False
        if guard and not self.uses_rules():
            out, near_constant = self._written(out)
        prob = "_rule" if self.uses_rules() or near_constant else "_ens"
        return out.select(*cols, F.col(prob).alias("default_prob"), F.col("_ew").alias("early_warning_score"), "cluster",
                          *[c for c in ("_ens", *extra) if extra])

    def score(self, df: DataFrame, guard: bool = True) -> DataFrame:
        """R6 in model mode: attach default_prob, early_warning_score, cluster.

        Single-class labels -> rule PD and rule EW (the forest cannot give a
        default probability); a near-constant ensemble over this table -> rule
        PD, model EW; otherwise both from the models (``guard=False``: always).
        Clusters come from k-means in every case.
        """
        return self._scored(self._outputs(df), df.columns, guard, ())

    def score_all(self, df: DataFrame) -> DataFrame:
        """Every model output of a table: the scores, the ensemble probability, the
        isolation forest's score and decision, and the predicted grade."""
        out = self._with_grade(self._outputs(df))
        out = self._scored(out, df.columns, True, ("_decision", "predicted_grade"))
        offset = F.lit(None).cast("double") if self.iso is None else F.lit(self.iso.offset)
        return out.withColumnsRenamed({"_ens": "ensemble_prob", "_decision": "decision"}).withColumn(
            "score", F.col("decision") + offset)

    def _with_grade(self, feat: DataFrame) -> DataFrame:
        """M9: the predicted grade of featurised rows (the grade they have when no model was fitted)."""
        if self.grade_lr is None:
            return feat.withColumn("predicted_grade", F.col("credit_quality"))
        labels = F.array(*[F.lit(g) for g in self.grade_labels])
        if isinstance(self.grade_lr, Multinomial):
            return feat.withColumn("predicted_grade", F.element_at(labels, self.grade_lr.label() + 1))
        # The margins over the plain columns: no vector is made for each row, and none of its margins and probabilities.
        margins = F.array(*multinomial_of(self.grade_lr, STD_COLS).margins())
        return feat.withColumn("predicted_grade", F.element_at(labels, F.array_position(margins, F.array_max(margins)).cast("int")))

    def assign_clusters(self, scored_feat: DataFrame) -> DataFrame:
        """M8: k-means segment id (0 when no model was fitted)."""
        if self.kmeans is None:
            return scored_feat.withColumn("cluster", F.lit(0))
        return scored_feat.withColumn("cluster", self.kmeans.cluster())

    # ----------------------------------------------------- save and load
    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        """Writes the bundle to a folder: MLlib models in their own format, boosting and everything else as Parquet."""
        path, mode = path.rstrip("/"), "overwrite" if overwrite else "error"
        meta = {"hyper": asdict(self.hyper), "n": self.n, "single_class": self.single_class, "grade_labels": self.grade_labels,
                "prob_std": self.prob_std, "auc": self.auc, "importances": self.importances, "means": self.encoder.means,
                "scales": self.encoder.scales, "codes": list(self.encoder.codes), "labelled": list(self.encoder.labels())}
        labels = [(c, i, v) for c, values in self.encoder.labels().items() for i, v in enumerate(values)]
        spark.createDataFrame(labels, "feature string, code int, label string").write.mode(mode).parquet(f"{path}/labels")
        for c, codes in self.encoder.codes.items():
            codes.write.mode(mode).parquet(f"{path}/codes-{c}")
        if self.iso is not None:
            meta["iso"] = {"psi": int(self.iso.psi), "max_depth": int(self.iso.max_depth), "offset": float(self.iso.offset)}
            spark.createDataFrame(self.iso.node_rows(), "at int, feature int, threshold double, `left` int, `right` int, "
                                  "leaf_path double, root boolean").write.mode(mode).parquet(f"{path}/isolation")
        meta["parts"] = []
        for name in PARTS:
            model = getattr(self, name)
            if model is not None:
                if not hasattr(model, "write"):
                    raise TypeError(f"{name} is an expression, not a fitted model")
                writer = model.write()
                (writer.overwrite() if overwrite else writer).save(f"{path}/{name}")
                meta["parts"].append(name)
        # Written last: a folder without it is no bundle.
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode(mode).parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LoanModels":
        """The bundle that ``save`` wrote."""
        path = path.rstrip("/")
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        labels: dict[str, list[str]] = {c: [] for c in meta["labelled"]}
        for r in sorted(spark.read.parquet(f"{path}/labels").collect(), key=lambda r: (r["feature"], r["code"])):
            labels[r["feature"]].append(r["label"])
        codes = {c: spark.read.parquet(f"{path}/codes-{c}") for c in meta["codes"]}
        m = LoanModels(FeatureEncoder.of_labels(labels, meta["means"], meta["scales"], codes), Hyper(**meta["hyper"]), meta["n"],
                       meta["single_class"], grade_labels=meta["grade_labels"], prob_std=meta["prob_std"], auc=meta["auc"],
                       importances=[(a, b) for a, b in meta["importances"]])
        if "iso" in meta:
            rows = [tuple(r) for r in spark.read.parquet(f"{path}/isolation").collect()]
            m.iso = IsolationForestModel.from_node_rows(rows, **meta["iso"])
        for name in meta["parts"]:
            setattr(m, name, PARTS[name].load(f"{path}/{name}"))
        return m


PARTS = {"rf": BaggedTrees, "gbt": BoostedTrees, "kmeans": Segments,
         "grade_lr": LogisticRegressionModel}


# ---------------------------------------------------------------------------
# Model outputs as DataFrames
# ---------------------------------------------------------------------------
def anomaly_scores(models: LoanModels, loans: DataFrame) -> DataFrame:
    """M6: per loan, isolation-forest score_samples and decision value."""
    feat = models.featurize(loans)
    if models.iso is None:
        return feat.select("loan_id", F.lit(None).cast("double").alias("score"),
                           F.lit(None).cast("double").alias("decision"))
    s = models.iso.score_column(STD_COLS)
    return feat.select("loan_id", s.alias("score")).withColumn("decision", F.col("score") - F.lit(models.iso.offset))


def ensemble_default_prob(models: LoanModels, loans: DataFrame) -> DataFrame:
    """Ensemble probability per loan (rule PD when the model is unusable)."""
    if models.uses_rules():
        return loans.select("loan_id", S.rule_default_prob().alias("default_prob"))
    return models._with_prob(models.featurize(loans)).select("loan_id", F.col("_ens").alias("default_prob"))


def stored_prob(scored: DataFrame) -> DataFrame:
    """R3 from a table of :meth:`LoanModels.score_all` (rule PD when the model is unusable)."""
    return scored.select("loan_id", F.coalesce("ensemble_prob", "default_prob").alias("default_prob"))


def predict_grade(models: LoanModels, loans: DataFrame) -> DataFrame:
    """M9: predicted grade from the multinomial classifier."""
    return models._with_grade(models.featurize(loans)).select("loan_id", "credit_quality", "predicted_grade")


def predict_loans(models: LoanModels, applications: DataFrame) -> DataFrame:
    """Score new applications, always by the ensemble when there is one
    (one application has no spread to guard). Absent numeric inputs count as
    0, absent categories as 'Unknown' (an unseen value -> index 0)."""
    df = applications
    for c in K.NUM_COLS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    for c in K.CAT_COLS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("Unknown"))
    if "loan_id" not in df.columns:
        df = df.withColumn("loan_id", F.lit(None).cast("string"))
    if "default_indicator" not in df.columns:
        df = df.withColumn("default_indicator", F.lit(0))
    if "delinquency_status" not in df.columns:
        df = df.withColumn("delinquency_status", F.lit("Current"))
    scored = models.score(df, guard=False)
    return scored.select("loan_id", rnd(F.col("default_prob"), 4).alias("default_probability"),
                         rnd(F.col("early_warning_score"), 1).alias("early_warning_score"),
                         risk_level("early_warning_score").alias("risk_level"))


def train_report(spark: SparkSession, models: LoanModels) -> DataFrame:
    """AUC (4dp, in-sample forest), sample count and the fitted parts."""
    return spark.createDataFrame(
        [(float(models.auc), int(models.n), models.rf is not None, models.gbt is not None, models.iso is not None,
          models.kmeans is not None, models.grade_lr is not None, float(models.prob_std or 0.0))],
        "auc double, n_samples bigint, has_forest boolean, has_boosting boolean, has_isolation boolean, "
        "has_kmeans boolean, has_grade_model boolean, prob_std double")


def feature_importance(spark: SparkSession, models: LoanModels) -> DataFrame:
    """T4: top-10 forest feature importances, descending, 4dp."""
    return spark.createDataFrame(models.importances or [], "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")
