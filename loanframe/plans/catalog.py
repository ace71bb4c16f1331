"""Named report plans: each entry builds a DataFrame from the driver tables.

A plan is a composition of operators over the derived inputs
(``loans`` / ``raw_loans`` / ``scored``). Registering a name here makes it
available to ``__spark_entry__.queries()``; an oracle statement of the same
name in :mod:`loanframe.plans.oracle_queries` makes it SQL-checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as A
from ..operators import scoring as S
from .. import constants as K
from ..session import spread
from ..sources import fixtures

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}


def plan(name: str):
    def deco(fn: Plan) -> Plan:
        PLANS[name] = fn
        return fn
    return deco


_INPUTS: dict = {}


def _memo(kind: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Build a derived input's logical plan once per session and dataset.

    DataFrames are immutable plans, so every report can start from the same
    object (as a user would keep ``loans`` / ``scored`` in a variable); only
    the plan is shared, nothing is cached: each report still reads just the
    columns it needs from parquet.
    """
    key = (kind, id(spark.sparkContext), sf_dir)
    if key not in _INPUTS:
        _INPUTS[key] = build()
    return _INPUTS[key]


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("loans", spark, sf_dir, lambda: fixtures.loans(spark, sf_dir))


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("raw", spark, sf_dir, lambda: fixtures.raw_loans(spark, sf_dir))


def scored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with rule scores attached (deterministic; every SQL check uses it)."""
    return _memo("scored", spark, sf_dir, lambda: S.score_rules(loans(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Segment reports (A2)
# ---------------------------------------------------------------------------
for _name, _key in [("segments_geography", "geography"), ("segments_employment", "employment_type"),
                    ("segments_product", "product_type"), ("segments_channel", "acquisition_channel"),
                    ("segments_grade", "credit_quality")]:
    PLANS[_name] = (lambda key: lambda spark, sf: A.segment_breakdown(scored_rules(spark, sf), key))(_key)


# ---------------------------------------------------------------------------
# Scoring (R1, R2, R4, R5, R6, R7, R9)
# ---------------------------------------------------------------------------
@plan("scored_loans")
def _scored_loans(spark, sf):
    return scored_rules(spark, sf)


@plan("rule_default_prob")
def _rule_default_prob(spark, sf):
    from pyspark.sql import functions as F
    from ..functions import rnd
    return loans(spark, sf).select(
        "loan_id", rnd(S.rule_pd_raw(), 4).alias("rule_pd"), S.rule_default_prob().alias("default_prob"))


@plan("rule_ew_score")
def _rule_ew_score(spark, sf):
    return loans(spark, sf).select("loan_id", S.rule_ew_score().alias("early_warning_score"))


@plan("ew_blend")
def _ew_blend(spark, sf):
    """R4 with the rule PD standing in for the model probability, no bonus."""
    return loans(spark, sf).select("loan_id", S.ew_blend(S.rule_default_prob()).alias("ew_blend"))


@plan("risk_level")
def _risk_level(spark, sf):
    return S.with_risk_level(scored_rules(spark, sf)).select("loan_id", "early_warning_score", "risk_level")


@plan("segment_bands")
def _segment_bands(spark, sf):
    return S.segment_bands(A.segment_breakdown(scored_rules(spark, sf), "geography"))


@plan("score_guard")
def _score_guard(spark, sf):
    from ..models.guard import prob_guard
    return prob_guard(scored_rules(spark, sf), "default_prob")


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
def _report(name: str, fn, src=scored_rules):
    PLANS[name] = lambda spark, sf: fn(src(spark, sf))


_report("portfolio_metrics", A.portfolio_metrics)
_report("risk_distribution", A.risk_distribution)
_report("nonempty_grades", A.nonempty_grades)
_report("grade_tiers", A.grade_tiers)
_report("pricing_by_grade", A.pricing_by_grade)
_report("cohort_analysis", A.cohort_analysis)
_report("ew_bands", A.ew_bands)
_report("ew_buckets", A.ew_buckets)
_report("cluster_profiles_rule", lambda s: A.cluster_profiles(A.ew_quartile_clusters(s)))
_report("scatter_grade", A.scatter_data)
_report("pricing_report", A.pricing_report)
_report("product_share", A.product_share)
_report("product_profitability", A.product_profitability)
_report("roi_best_worst", A.roi_best_worst)
_report("best_worst_geography", lambda s: A.best_worst(s, "geography"))
_report("best_worst_product", lambda s: A.best_worst(s, "product_type"))


@plan("active_or_all")
def _active_or_all(spark, sf):
    from ..session import materialize
    return A.active_or_all(materialize(scored_rules(spark, sf), "scored-rules"))


_report("grade_lookup_join", A.grade_lookup_join, loans)
_report("auc_rule", A.auc_rule, loans)
_report("auc_rule_unrounded", A.auc_rule_unrounded, loans)
_report("score_ranks", A.score_ranks, loans)
_report("scatter_bubbles", lambda s: A.scatter_bubbles(A.scatter_data(s)))
_report("segments_present", lambda s: A.segments_present(s, ["geography", "branch_code", "product_type"]))
_report("distinct_grades", A.distinct_grades, loans)
_report("class_counts", A.class_counts, loans)
_report("load_summary", A.load_summary, loans)
_report("status_counts", A.status_counts, loans)


# ---------------------------------------------------------------------------
# Watch-lists
# ---------------------------------------------------------------------------
from ..operators import topk as T  # noqa: E402

_report("early_warning_top50", T.early_warning_signals)
_report("early_warning_top8", lambda s: T.early_warning_signals(s, K.CARD_LIST_SIZE))
_report("early_warning_by_grade", lambda s: T.early_warning_by_grade(s, "CCC"))


# ---------------------------------------------------------------------------
# Formatting and benchmark status
# ---------------------------------------------------------------------------
@plan("inr_format")
def _inr_format(spark, sf):
    from pyspark.sql import functions as F
    from ..functions import inr_format
    seg = A.pricing_report(scored_rules(spark, sf))
    return seg.select("dimension", "segment", "totalDisbursed", inr_format("totalDisbursed").alias("aum_text"),
                      inr_format(F.col("count") * F.col("avgPricing") * F.lit(1000.0)).alias("revenue_text"))


@plan("benchmark_status")
def _benchmark_status(spark, sf):
    from ..operators.policy import benchmark_status
    return benchmark_status(A.portfolio_metrics(scored_rules(spark, sf)))


# ---------------------------------------------------------------------------
# Normalisation of the messy upload
# ---------------------------------------------------------------------------
from ..operators import normalize as N  # noqa: E402

_STEP_COLUMNS = {
    "normalize_headers": ["loan_id", "loan_size", "credit_score", "credit_quality", "geography", "employment_type",
                          "product_type", "pricing_rate", "default_indicator", "delinquency_status",
                          "tenure_months", "acquisition_channel", "income_proxy", "dti_ratio"],
    "normalize_grade": ["loan_id", "credit_quality"],
    "grade_from_score": ["loan_id", "credit_quality"],
    "normalize_employment": ["loan_id", "employment_type"],
    "normalize_product": ["loan_id", "product_type"],
    "normalize_geography": ["loan_id", "geography"],
    "normalize_channel": ["loan_id", "acquisition_channel"],
    "parse_default_flag": ["loan_id", "default_indicator"],
    "parse_delinquency": ["loan_id", "delinquency_status"],
    "loan_status": ["loan_id", "loan_status"],
    "coerce_numeric": ["loan_id", *K.NUMERIC_DEFAULTS],
    "fill_strings": ["loan_id", *K.STRING_DEFAULTS],
}

for _step, _cols in _STEP_COLUMNS.items():
    PLANS[_step] = (lambda step, cols: lambda spark, sf: N.normalize_until(
        raw_loans(spark, sf), step).select(*cols))(_step, _cols)


@plan("normalize_loans")
def _normalize_loans(spark, sf):
    return N.normalize_loans(raw_loans(spark, sf))


def scored_upload(spark, sf) -> DataFrame:
    """A messy upload with fractional amounts and scores and three-decimal rates, normalised and rule-scored."""
    from pyspark.sql import functions as F
    n = F.substring("loan_id", 4, 20).cast("long")
    part = F.element_at(F.array(*[F.lit(x) for x in ("", ".25", ".5", ".75")]), (n % 4 + 1).cast("int"))
    raw = raw_loans(spark, sf).withColumns({
        "loan_amount": F.concat("loan_amount", part),
        "cibil_score": F.when((n % 3 == 0) & (F.col("cibil_score") != "abc"), F.concat("cibil_score", F.lit(".9")))
        .otherwise(F.col("cibil_score")),
        "interest_rate": F.when(n % 37 != 0, F.concat("interest_rate", F.lit("5"))).otherwise(F.col("interest_rate"))})
    return S.score_rules(N.normalize_loans(raw))


_report("portfolio_metrics_upload", A.portfolio_metrics, scored_upload)
_report("segments_upload", lambda s: A.segment_breakdown(s, "geography"), scored_upload)


@plan("watch_bands")
def _watch_bands(spark, sf):
    return S.watch_bands(T.early_warning_signals(scored_rules(spark, sf)))


@plan("cohort_bands")
def _cohort_bands(spark, sf):
    return S.cohort_bands(A.cohort_analysis(scored_rules(spark, sf)))


@plan("assign_loan_ids")
def _assign_loan_ids(spark, sf):
    """Ids by position in an explicit order (the upload's reference column), all columns kept."""
    return N.assign_loan_ids(raw_loans(spark, sf).withColumnRenamed("loan_id", "ref"), order_col="ref")


@plan("cohort_bucket")
def _cohort_bucket(spark, sf):
    return N.cohort_bucket(loans(spark, sf).drop("cohort")).select("loan_id", "origination_month", "cohort")


@plan("value_proxy")
def _value_proxy(spark, sf):
    return N.value_proxy(loans(spark, sf).drop("value_proxy")).select("loan_id", "value_proxy")


@plan("derived_ratios")
def _derived_ratios(spark, sf):
    return N.derive_ratios(loans(spark, sf)).select("loan_id", "ltv_ratio", "dti_ratio")


def _csv_upload(spark, sf, note):
    """The messy upload (with no-break spaces and a note) written as CSV to the shared folder; its path."""
    import os
    import uuid
    from pyspark.sql import functions as F
    from ..session import ensure_checkpoint_dir
    from ..sources.csv import write_loans_csv
    path = os.path.join(ensure_checkpoint_dir(spark), f"upload-{uuid.uuid4().hex[:12]}")
    odd = F.substring("loan_id", 4, 20).cast("long") % 13 == 0
    raw = raw_loans(spark, sf).withColumns({
        "region": F.when(odd, F.concat("region", F.lit("\u00a0"))).otherwise(F.col("region")),
        "note": F.concat(F.lit(note), "loan_id")})
    write_loans_csv(raw, path)
    return path


@plan("csv_roundtrip")
def _csv_roundtrip(spark, sf):
    """An upload with notes of two lines, read back and normalised in one scan."""
    from ..sources.csv import read_loans_table
    return read_loans_table(spark, _csv_upload(spark, sf, "first\n"), multi_line=True)


@plan("csv_upload_lines")
def _csv_upload_lines(spark, sf):
    """An upload of one line a row, whose files are read in splits."""
    from ..sources.csv import read_loans_table
    return read_loans_table(spark, _csv_upload(spark, sf, "first "))


# ---------------------------------------------------------------------------
# Models (M1-M11, R3, R4, R8, T4, A7 with k-means): rows-only checks
# ---------------------------------------------------------------------------
_MODEL_MEMO: dict = {}


def fitted_models(spark: SparkSession, sf: str):
    """Fit once per (session, dataset) and share across the model queries."""
    from ..models.bundle import LoanModels
    key = (id(spark.sparkContext), sf)
    if key not in _MODEL_MEMO:
        _MODEL_MEMO[key] = LoanModels.fit(loans(spark, sf))
    return _MODEL_MEMO[key]


def scored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Loans with every model output, written once to the shared checkpoint
    folder so every report reads the result instead of re-running inference."""
    key = ("scored", id(spark.sparkContext), sf)
    if key not in _MODEL_MEMO:
        _MODEL_MEMO[key] = fitted_models(spark, sf).score_all(spread(loans(spark, sf)))
    return _MODEL_MEMO[key]


@plan("ensemble_default_prob")
def _ensemble_default_prob(spark, sf):
    from ..models.bundle import stored_prob
    return stored_prob(scored_models(spark, sf))


@plan("ml_ew_score")
def _ml_ew_score(spark, sf):
    return scored_models(spark, sf).select("loan_id", "default_prob", "early_warning_score")


@plan("anomaly_scores")
def _anomaly_scores(spark, sf):
    return scored_models(spark, sf).select("loan_id", "score", "decision")


@plan("anomaly_scores_fixed")
def _anomaly_scores_fixed(spark, sf):
    """Model scoring checked by value: a forest of fixed nodes, its bonus in the early-warning score."""
    from ..models.fixed import anomaly_scores_fixed
    return anomaly_scores_fixed(loans(spark, sf))


@plan("forest_fixed")
def _forest_fixed(spark, sf):
    """M3, M4: trees of fixed nodes as expressions."""
    from ..models.fixed import probabilities_fixed
    return probabilities_fixed(loans(spark, sf))


def _fixed(spark, sf) -> DataFrame:
    """Loans with every output of the fixed bundle, through the same code as a fitted one."""
    from ..models.fixed import fixed_models
    return fixed_models().score_all(loans(spark, sf))


@plan("ensemble_fixed")
def _ensemble_fixed(spark, sf):
    from ..models.bundle import ensemble_default_prob
    from ..models.fixed import fixed_models
    return ensemble_default_prob(fixed_models(), loans(spark, sf))


@plan("ml_scores_fixed")
def _ml_scores_fixed(spark, sf):
    """R6 in model mode with the guard on the whole table, by value."""
    from ..functions import rnd
    return _fixed(spark, sf).select("loan_id", "default_prob", "early_warning_score", "cluster", rnd("score", 6).alias("score"),
                                    rnd("decision", 6).alias("decision"), "predicted_grade")


@plan("cluster_assign_fixed")
def _cluster_assign_fixed(spark, sf):
    from ..models.fixed import fixed_models
    m = fixed_models()
    return m.assign_clusters(m.featurize(loans(spark, sf))).select("loan_id", "cluster")


_report("cluster_profiles_fixed", A.cluster_profiles, _fixed)


@plan("predict_grade_fixed")
def _predict_grade_fixed(spark, sf):
    from ..models.bundle import predict_grade
    from ..models.fixed import fixed_models
    return predict_grade(fixed_models(), loans(spark, sf))


_report("grade_confusion_fixed", A.grade_confusion, _predict_grade_fixed)
_report("grade_accuracy_fixed", A.grade_accuracy, _predict_grade_fixed)


def _applications(spark, sf) -> DataFrame:
    """New applications with part of the inputs; every 17th comes from a place that no label knows."""
    from pyspark.sql import functions as F
    far = F.substring("loan_id", 4, 20).cast("long") % 17 == 0
    return loans(spark, sf).select("loan_id", "credit_score", "loan_size", "pricing_rate", "dti_ratio", "income_proxy",
                                   "tenure_months", F.when(far, "Mars").otherwise(F.col("geography")).alias("geography"),
                                   "product_type", "credit_quality")


@plan("predict_loans_fixed")
def _predict_loans_fixed(spark, sf):
    from ..models.bundle import predict_loans
    from ..models.fixed import fixed_models
    return predict_loans(fixed_models(), _applications(spark, sf))


@plan("predict_loans_reloaded")
def _predict_loans_reloaded(spark, sf):
    """R8 with a bundle that was saved to the shared folder and loaded again."""
    from ..models.bundle import LoanModels, predict_loans
    from ..session import ensure_checkpoint_dir
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex[:12]}"
    fitted_models(spark, sf).save(spark, path)
    return predict_loans(LoanModels.load(spark, path), spread(_applications(spark, sf)))


@plan("cluster_assign")
def _cluster_assign(spark, sf):
    return scored_models(spark, sf).select("loan_id", "cluster")


@plan("cluster_profiles")
def _cluster_profiles(spark, sf):
    return A.cluster_profiles(scored_models(spark, sf))


@plan("predict_grade")
def _predict_grade(spark, sf):
    return scored_models(spark, sf).select("loan_id", "credit_quality", "predicted_grade")


_report("grade_confusion", A.grade_confusion, _predict_grade)
_report("grade_accuracy", A.grade_accuracy, _predict_grade)


@plan("predict_loans")
def _predict_loans(spark, sf):
    """New applications carrying only part of the inputs (the rest default)."""
    from ..models.bundle import predict_loans
    apps = loans(spark, sf).select("loan_id", "credit_score", "loan_size", "pricing_rate", "dti_ratio",
                                            "income_proxy", "tenure_months", "geography", "product_type",
                                            "credit_quality")
    return predict_loans(fitted_models(spark, sf), spread(apps))


@plan("train_report")
def _train_report(spark, sf):
    from ..models.bundle import train_report
    return train_report(spark, fitted_models(spark, sf))


@plan("feature_importance")
def _feature_importance(spark, sf):
    from ..models.bundle import feature_importance
    return feature_importance(spark, fitted_models(spark, sf))


@plan("ml_portfolio_metrics")
def _ml_portfolio_metrics(spark, sf):
    return A.portfolio_metrics(scored_models(spark, sf))


# ---------------------------------------------------------------------------
# Policy (P1-P6)
# ---------------------------------------------------------------------------
from ..operators import policy as P  # noqa: E402

_report("policy_recommendations", P.policy_recommendations)
_report("policy_memo", P.policy_memo)
_report("segment_summaries", P.segment_summaries)


# ---------------------------------------------------------------------------
# Streaming scoring
# ---------------------------------------------------------------------------
@plan("stream_scored_loans")
def _stream_scored_loans(spark, sf):
    """The loans table landed as files, scored by a file-source stream
    (availableNow) into parquet, read back."""
    import os
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.scoring import read_loan_stream, run_available_now, score_stream
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:12]}")
    batch = loans(spark, sf)
    batch.write.parquet(os.path.join(base, "landing"))
    stream = read_loan_stream(spark, os.path.join(base, "landing"), batch.schema)
    out = run_available_now(score_stream(stream), os.path.join(base, "scored"))
    return spark.read.parquet(out)


# ---------------------------------------------------------------------------
# Feature encoding (M1, M2): exact SQL checks of the fitted encoder
# ---------------------------------------------------------------------------
def _encoder(spark, sf):
    from ..models.features import FeatureEncoder
    key = ("encoder", id(spark.sparkContext), sf)
    if key not in _MODEL_MEMO:
        _MODEL_MEMO[key] = FeatureEncoder.fit(loans(spark, sf))
    return _MODEL_MEMO[key]


@plan("encode_categories")
def _encode_categories(spark, sf):
    """M1: alphabetical label codes of the five categorical features."""
    enc = _encoder(spark, sf)
    raw = enc._raw(loans(spark, sf))
    return raw.select("loan_id", *[raw[f"cat_{c}"].cast("int").alias(f"cat_{c}") for c in K.CAT_COLS])


@plan("encode_categories_joined")
def _encode_categories_joined(spark, sf):
    """M1 beyond the driver's labels: the codes are stored tables of dense ranks, joined back."""
    from ..models.features import FeatureEncoder
    enc = FeatureEncoder.fit(loans(spark, sf), max_labels=3)
    raw = enc._raw(loans(spark, sf))
    return raw.select("loan_id", *[raw[f"cat_{c}"].cast("int").alias(f"cat_{c}") for c in K.CAT_COLS])


@plan("dense_codes")
def _dense_codes(spark, sf):
    """M1 on a column of very many values: the loan sizes as text."""
    from ..operators.ranks import dense_codes
    return dense_codes(loans(spark, sf), "loan_size")


@plan("standardize_features")
def _standardize_features(spark, sf):
    """M2: population-std z-scores (4dp) of all 15 features."""
    from ..functions import rnd
    from ..models.features import FEATURE_NAMES, STD_COLS
    z = _encoder(spark, sf).standardized(loans(spark, sf))
    return z.select("loan_id", *[rnd(z[STD_COLS[i]], 4).alias(f"z_{c}") for i, c in enumerate(FEATURE_NAMES)])


@plan("hyperparameters")
def _hyperparameters(spark, sf):
    """M11 for each small segment of the book."""
    from pyspark.sql import functions as F
    from ..models.features import hyper_columns
    keys = ["geography", "product_type", "employment_type", "credit_quality"]
    n = loans(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, "n", *[c.alias(name) for name, c in hyper_columns(F.col("n")).items()])


@plan("isolation_rows")
def _isolation_rows(spark, sf):
    """the loans that the isolation forest learns from, of the book and of a segment with few active loans."""
    from pyspark.sql import functions as F
    from ..models.bundle import isolation_rows
    book = loans(spark, sf)
    few = book.where("loan_status <> 'Active'")
    parts = [isolation_rows(df, df.where("loan_status = 'Active'").count()).select(F.lit(name).alias("part"), "loan_id")
             for name, df in (("book", book), ("few", few))]
    return parts[0].unionByName(parts[1])


@plan("score_quantiles")
def _score_quantiles(spark, sf):
    """M5's offset rule: exact quantiles of unrounded scores, by refining a histogram."""
    from pyspark.sql import functions as F
    from ..functions import rnd
    from ..operators.ranks import quantiles
    from ..session import materialize
    # The loans are derived once: every pass reads the stored scores.
    scores = materialize(loans(spark, sf).select(S.rule_pd_raw().alias("s")), "rule-scores")
    shares = (0.05, 0.12, 0.5, 0.993)
    got = list(zip(shares, quantiles(scores, "s", shares)))
    return spark.createDataFrame(got, "share double, value double").select("share", rnd(F.col("value"), 9).alias("value"))


@plan("short_number")
def _short_number(spark, sf):
    """Chart axis text of report values."""
    from pyspark.sql import functions as F
    from ..functions import short_number
    seg = A.pricing_report(scored_rules(spark, sf))
    return seg.select("dimension", "segment", *[short_number(c).alias(f"{c}_text") for c in (
        "totalDisbursed", "count", "avgPricing", "defaultRate")],
        short_number(-F.col("avgScore") * F.lit(1234.5)).alias("negative_text"), short_number(F.lit(None)).alias("missing_text"))
