"""Risk scoring: per-row column expressions (R1, R2, R4 base, R6, R7, R9).

Everything here is a projection, so scoring never shuffles and works the
same on a batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import badge, clip, lookup, risk_level, rnd


def grade_pd(grade="credit_quality") -> Column:
    """Rule PD of a grade; unknown grades get the fixed fallback."""
    g = F.col(grade) if isinstance(grade, str) else grade
    return F.coalesce(lookup(K.RULE_GRADE_PD, g), F.lit(K.RULE_UNKNOWN_GRADE_PD))


def rule_pd_raw() -> Column:
    """Rule PD before the 'already defaulted -> 1.0' override, unrounded."""
    dti_adj = clip("dti_ratio", 0.0, 0.8) / F.lit(0.8) * F.lit(0.15)
    score_adj = clip((F.lit(750) - clip("credit_score", 300, 900)) / F.lit(750) * F.lit(0.10), 0.0, 0.10)
    return clip(grade_pd() + dti_adj + score_adj, 0.0, 1.0)


def rule_default_prob() -> Column:
    """R(4) of 1.0 for defaulted loans, else the clipped rule PD."""
    return rnd(F.when(F.col("default_indicator") == 1, F.lit(1.0)).otherwise(rule_pd_raw()), 4)


def ew_base() -> Column:
    """The four behavioural terms of the early-warning score (no status boost)."""
    cf = (F.lit(1.0) - clip("cashflow_consistency", 0.0, 1.0)) * F.lit(30.0)
    bal = clip("balance_volatility", 0.0, 1.0) * F.lit(25.0)
    shock = F.col("spending_shock").cast("double") * F.lit(20.0)
    dti = clip("dti_ratio", 0.0, 0.8) / F.lit(0.8) * F.lit(25.0)
    return cf + bal + shock + dti


def rule_ew_score() -> Column:
    """R2: R(1) of clip(base + boost, 0, 100); boost 30 if defaulted, 15 if DPD30+."""
    boost = (F.when(F.col("default_indicator") == 1, F.lit(30.0))
             .when(F.col("delinquency_status") == "DPD30+", F.lit(15.0)).otherwise(F.lit(0.0)))
    return rnd(clip(ew_base() + boost, 0.0, 100.0), 1)


def ew_blend(prob: Column, anomaly_bonus: Column | None = None) -> Column:
    """clip(base, 0, 100) * .6 + prob * 100 * .4 (+ anomaly bonus), clipped, R(1)."""
    score = clip(ew_base(), 0.0, 100.0) * F.lit(0.6) + prob * F.lit(100.0) * F.lit(0.4)
    if anomaly_bonus is not None:
        score = clip(score + anomaly_bonus, 0.0, 100.0)
    return rnd(score, 1)


def score_rules(df: DataFrame) -> DataFrame:
    """R6 in rule mode: attach default_prob, early_warning_score, cluster 0."""
    return df.withColumns({
        "default_prob": rule_default_prob(),
        "early_warning_score": rule_ew_score(),
        "cluster": F.lit(0),
    })


def score_loans(df: DataFrame, models=None) -> DataFrame:
    """Attach scores. ``models`` is a fitted :class:`loanframe.models.LoanModels`
    bundle or None (rule mode)."""
    if models is None:
        return score_rules(df)
    return models.score(df)


def with_risk_level(df: DataFrame, ew: str = "early_warning_score") -> DataFrame:
    """R7."""
    return df.withColumn("risk_level", risk_level(ew))


def segment_bands(df: DataFrame) -> DataFrame:
    """Dashboard badge bands for a segment or grade report row."""
    out = df
    if "defaultRate" in df.columns:
        out = out.withColumn("defaultBand", badge("defaultRate", 15, 8))
        out = out.withColumn("cohortBand", badge("defaultRate", 12, 7))
        out = out.withColumn("pricingBand", badge("defaultRate", 12))
    return out


def cohort_bands(df: DataFrame) -> DataFrame:
    """Badge bands of a cohort report row."""
    return df.withColumn("cohortBand", badge("defaultRate", 12, 7)).withColumn(
        "delinqBand", F.when(F.col("delinqRate") > 15, "warning").otherwise("neutral"))


def watch_bands(df: DataFrame) -> DataFrame:
    """Badge band of a watch-list row."""
    return df.withColumn("ewBand", badge("early_warning_score", 60, 40))
