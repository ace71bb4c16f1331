"""Threshold bands used by the scoring and report operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import col_


def risk_level(ew) -> Column:
    """Predict-time level: > 60 High, > 40 Medium, else Low (40 itself is Low)."""
    s = col_(ew)
    return F.when(s > 60, "High").when(s > 40, "Medium").otherwise("Low")


def badge(value, danger: float, warning: float | None = None) -> Column:
    """Dashboard badge: danger above ``danger``, warning above ``warning``,
    success otherwise; with no warning threshold the band is two-way
    (danger / warning)."""
    v = col_(value)
    if warning is None:
        return F.when(v > danger, "danger").otherwise("warning")
    return F.when(v > danger, "danger").when(v > warning, "warning").otherwise("success")


def ew_bucket(ew) -> Column:
    """0-20, 20-40, 40-60, 60-80 are left-closed; 80-100 is closed both ends."""
    s = col_(ew)
    idx = F.least(F.floor(s / F.lit(20.0)), F.lit(4)).cast("int")
    return F.when((s >= 0) & (s <= 100), F.element_at(F.array(*[F.lit(b) for b in K.EW_BUCKETS]), idx + 1))


def grade_tier(grade) -> Column:
    g = col_(grade)
    out = None
    for name in K.TIER_ORDER:
        members = [k for k, v in K.GRADE_TIERS.items() if v == name]
        out = (F.when if out is None else out.when)(g.isin(members), F.lit(name))
    return out


def score_to_grade(score) -> Column:
    """Credit score -> grade by the fixed cut-offs; NULL / NaN give CCC
    (every comparison is false)."""
    s = col_(score)
    out = None
    for cut, grade in K.SCORE_GRADE_CUTOFFS:
        cond = s >= F.lit(cut)
        out = F.when(cond, grade) if out is None else out.when(cond, grade)
    return out.otherwise("CCC")
