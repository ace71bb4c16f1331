"""DuckDB statements of model scoring with the fixed models, written by hand beside their own copy of the values."""

from __future__ import annotations

from . import oracle_values as K
from .oracle import CLIP, EW_BASE, R, RULE_PD, big, case_map, dmean, imean, itrunc, q, with_loans

# Label codes (by place), means and scales of the numeric features.
LABELS = {
    'geography': ['Metro', 'Rural', 'Tier-2'],
    'employment_type': ['Gig Worker', 'Informal', 'Salaried', 'Self-Employed', 'Small Business'],
    'credit_quality': ['A', 'AA', 'AAA', 'B', 'BB', 'BBB'],
}
SCALED = {'credit_score': (700, 100), 'pricing_rate': (15, 5), 'dti_ratio': (0.3, 0.2), 'cashflow_consistency': (0.5, 0.25),
          'balance_volatility': (0.4, 0.2)}
CENTRES = [(0.5, -0.5, 0.4, -0.5), (-0.5, 0.5, -0.4, 0.5), (1.2, -1.0, 1.0, -1.0), (-1.5, 1.5, -0.8, 1.2), (-0.5, 0.5, -0.4, 0.5)]
GRADE_MODEL = {'A': (0.4, -0.3, -0.1, 0.2), 'AA': (0.9, -0.6, -0.1, 0.0), 'AAA': (1.5, -0.9, -0.2, -0.5), 'B': (-0.9, 0.5, 0.1, -0.2),
               'BB': (-0.4, 0.3, 0.0, 0.1), 'BBB': (0.0, 0.0, 0.0, 0.3), 'CCC': (-1.4, 0.9, 0.3, -0.7)}

_FOREST = """((0e0 + CASE WHEN z_credit_score <= -0.6e0 THEN CASE WHEN z_dti_ratio <= 0.25e0 THEN 0.18e0 ELSE 0.42e0 END ELSE 0.05e0 END
  + CASE WHEN k_credit_quality <= 2 THEN 0.08e0 WHEN z_balance_volatility <= 1e0 THEN 0.15e0 ELSE 0.33e0 END
  + CASE WHEN z_pricing_rate <= 0.8e0 THEN 0.06e0 ELSE 0.27e0 END) / 3e0)"""
_MARGIN = """(0e0 + CASE WHEN z_credit_score <= 0e0 THEN -0.7e0 ELSE -1.1e0 END * 1e0
  + CASE WHEN z_dti_ratio <= 0.5e0 THEN -0.3e0 ELSE 0.9e0 END * 0.1e0 + CASE WHEN k_employment_type <= 1 THEN 0.4e0 ELSE -0.2e0 END * 0.1e0)"""
_BOOSTING = f"(1e0 / (1e0 + exp({_MARGIN} * -2e0)))"


def _c(m: int) -> str:
    return f"(2e0 * (ln({m - 1}e0) + 0.5772156649015329e0) - 2e0 * {m - 1}e0 / {m}e0)"


_PATHS = f"""(CASE WHEN z_credit_score <= -0.6e0 THEN CASE WHEN z_dti_ratio <= 0.25e0 THEN 2e0 + {_c(66)} ELSE 2e0 + {_c(4)} END
    ELSE 1e0 + {_c(186)} END + CASE WHEN z_balance_volatility <= 2e0 THEN 1e0 + {_c(254)} ELSE 2e0 END)"""
_ANOMALY = f"(-pow(2e0, -({_PATHS} / 2e0) / {_c(256)}))"


def _sum(terms) -> str:
    return "(0e0 + " + " + ".join(terms) + ")"


def _features(src: str) -> str:
    codes = ", ".join(f"{case_map(c, {v: i for i, v in enumerate(values)}, '0')} AS k_{c}" for c, values in LABELS.items())
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - {m}e0) / {s}e0 AS z_{c}" for c, (m, s) in SCALED.items())
    return f"fx AS (SELECT *, {codes}, {scaled} FROM {src})"


_DIST = [_sum(f"(z_{f} - ({c}e0)) * (z_{f} - ({c}e0))" for f, c in zip(
    ("credit_score", "dti_ratio", "cashflow_consistency", "balance_volatility"), centre)) for centre in CENTRES]
_MARGINS = [(g, _sum(f"z_{f} * ({w}e0)" for f, w in zip(("credit_score", "pricing_rate", "dti_ratio"), row)) + f" + ({row[3]}e0)")
            for g, row in GRADE_MODEL.items()]


def _scores(src: str) -> str:
    """fx, then md: every model output."""
    clusters = ", ".join(f"{d} AS d{i}" for i, d in enumerate(_DIST))
    margins = ", ".join(f"{m} AS m_{g}" for g, m in _MARGINS)
    least = "least(" + ", ".join(f"d{i}" for i in range(len(_DIST))) + ")"
    most = "greatest(" + ", ".join(f"m_{g}" for g, _ in _MARGINS) + ")"
    cluster = "CASE " + " ".join(f"WHEN d{i} = {least} THEN {i}" for i in range(len(_DIST))) + " END"
    grade = "CASE " + " ".join(f"WHEN m_{g} = {most} THEN {q(g)}" for g, _ in _MARGINS) + " END"
    ew = (CLIP(EW_BASE, '0e0', '100e0') + " * 0.6e0 + ens * 100e0 * 0.4e0 + " + CLIP("-(s + 0.5e0)", "0e0", "1e0") + " * 10e0")
    return f"""{_features(src)},
mo AS (SELECT *, {_FOREST} AS rf, {_BOOSTING} AS gb, {_ANOMALY} AS s, {clusters}, {margins} FROM fx),
me AS (SELECT *, {R('rf * 0.6e0 + gb * 0.4e0', 4)} AS ens FROM mo),
md AS (SELECT *, {R(CLIP(ew, '0e0', '100e0'), 1)} AS ew, {cluster} AS model_cluster, {grade} AS predicted_grade FROM me)"""


# The spread of the whole table decides which probability is the default probability.
_GUARDED = f"""guarded AS (
  SELECT * EXCLUDE (ew), CASE WHEN (SELECT stddev_pop(ens) FROM md) < {K.PROB_STD_FLOOR}e0 THEN {RULE_PD} ELSE ens END AS default_prob,
    ew AS early_warning_score, model_cluster AS cluster FROM md)"""

_BASE = with_loans(", " + _scores("loans") + ", " + _GUARDED)

MODELS: dict[str, str] = {}
MODELS["forest_fixed"] = _BASE + f"SELECT loan_id, {R('rf', 6)} AS forest_prob, {R('gb', 6)} AS boosting_prob FROM md"
MODELS["ensemble_fixed"] = _BASE + "SELECT loan_id, ens AS default_prob FROM md"
MODELS["ml_scores_fixed"] = _BASE + f"""SELECT loan_id, default_prob, early_warning_score, cluster, {R('s', 6)} AS score,
  {R('s + 0.5e0', 6)} AS decision, predicted_grade FROM guarded"""
MODELS["cluster_assign_fixed"] = _BASE + "SELECT loan_id, model_cluster AS cluster FROM md"
_NAMES = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(K.CLUSTER_NAMES))
MODELS["cluster_profiles_fixed"] = _BASE + f""", p AS (
  SELECT cluster, count(*) AS "count", {itrunc(imean('credit_score'))} AS "avgCreditScore",
    {R(dmean('pricing_rate', 9, 2), 2)} AS "avgPricing", {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
    {R(dmean('early_warning_score', 9, 1), 1)} AS "avgEWScore", {big('sum(loan_size)')} AS "totalAUM"
  FROM guarded GROUP BY cluster),
r AS (SELECT *, row_number() OVER (ORDER BY "avgEWScore", cluster) - 1 AS rk FROM p)
SELECT cluster, CASE rk {_NAMES} ELSE 'Cluster ' || CAST(cluster AS VARCHAR) END AS name,
  "count", "avgCreditScore", "avgPricing", "defaultRate", "avgEWScore", "totalAUM" FROM r"""
MODELS["predict_grade_fixed"] = _BASE + "SELECT loan_id, credit_quality, predicted_grade FROM md"
MODELS["grade_confusion_fixed"] = _BASE + 'SELECT credit_quality, predicted_grade, count(*) AS "count" FROM md GROUP BY 1, 2'
MODELS["grade_accuracy_fixed"] = _BASE + f"""SELECT count(*) AS n, count(*) FILTER (credit_quality = predicted_grade) AS correct,
  {R('CAST(count(*) FILTER (credit_quality = predicted_grade) AS DOUBLE) / count(*)', 4)} AS accuracy FROM md"""

# New applications: only some inputs are there, and every 17th comes from a place no label knows.
_APPS = """apps AS (
  SELECT loan_id, credit_score, loan_size, pricing_rate, dti_ratio, income_proxy, tenure_months, product_type, credit_quality,
    CASE WHEN CAST(substr(loan_id, 4) AS BIGINT) % 17 = 0 THEN 'Mars' ELSE geography END AS geography,
    'Unknown' AS employment_type, 0e0 AS cashflow_consistency, 0e0 AS balance_volatility, 0e0 AS spending_shock, 0e0 AS ltv_ratio
  FROM loans)"""
MODELS["predict_loans_fixed"] = with_loans(f", {_APPS}, {_scores('apps')}") + f"""
SELECT loan_id, {R('ens', 4)} AS default_probability, {R('ew', 1)} AS early_warning_score,
  CASE WHEN ew > 60 THEN 'High' WHEN ew > 40 THEN 'Medium' ELSE 'Low' END AS risk_level FROM md"""
