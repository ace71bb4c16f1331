"""Policy recommendations built from report rows.

Inputs are the one-row / few-row reports (KPIs, grade distribution, EW
bands, best / worst segments). They are not joined: each report becomes a
struct column, the few rows are unioned, and one global aggregate folds
them into a single facts row (over < 20 rows). The six recommendations
are then produced with ``inline`` from that row.

Text is plain (no markup). Every number is rounded with the shared
half-to-even rule to the precision it is printed with before formatting,
so the printed digits do not depend on the formatter's own rounding.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rnd
from . import reports as A

# ---------------------------------------------------------------------------
# Titles and sentences of the recommendations, the memo and the
# segment lines. A name in braces stands for a figure of the report.
# ---------------------------------------------------------------------------
RECOMMENDATIONS = [
    ("Executive Summary",
     "Portfolio of {loans} loans with AUM of ₹{aum}Cr. Actual default rate: {default}% — {status} the {benchmark}% industry benchmark. "
     "ML-predicted average default probability: {prob}%. Average Credit Score: {score}. Avg Early Warning Score: {ew}/100."),
    ("ML Model — Default Risk Analysis",
     "Random Forest + Gradient Boosting ensemble trained on {loans} loans. CCC-grade segment: {ccc} loans, ML-estimated default "
     "probability: {ccc_pd}%. BB-grade: {bb} loans at {bb_pd}% ML prob. B-grade: {b} loans at {b_pd}% ML prob. {action}"),
    ("Early Warning — Isolation Forest Signals",
     "Isolation Forest anomaly detection: {high} loans flagged as high-risk (score > 60). {medium} loans in medium-risk zone (40–60). "
     "{shocks} loans show spending shock signals. Risk distribution — High: {high} | Medium: {medium} | Low: {low}. "
     "Action: Deploy automated nudges at DPD-7, personal outreach at DPD-15."),
    ("Geographic Risk Analysis",
     "Best performing geography: {best} (default rate: {best_rate}%, AUM: ₹{best_aum}L). Highest risk geography: {worst} "
     "(default rate: {worst_rate}%, ML prob: {worst_pd}%). Action: Expand originations in {best}; tighten criteria in {worst}."),
    ("Product Portfolio Optimization",
     "Best performing product: {best} (default rate: {best_rate}%, avg pricing: {best_price}%). Highest-risk product: {worst} "
     "(default rate: {worst_rate}%). Action: Increase allocation to {best}. Review pricing model for {worst}."),
    ("Pricing & ROI Recommendation",
     "Current avg pricing: {price}%. At-risk AUM: ₹{at_risk}Cr. Risk-adjusted pricing floor: Rate = Base + (PD × LGD × 100). "
     "Total value proxy: ₹{value}Cr. Action: Re-price BB/B segments upward by 2–3%. Prioritise high-margin, low-risk originations."),
]
CCC_ACTION = ("Action: Halt new CCC originations. Tighten underwriting for BB/B-grade loans "
              "(DTI > 0.4 or LTV > 1.5).")
MEMO = [
    ("Executive Summary",
     "Portfolio of {loans} loans with AUM of ₹{aum}Cr. ML-predicted avg default probability: {prob}%. Actual default rate {default}% is "
     "{side} the 8% industry benchmark. Average Early Warning Score: {ew}/100."),
    ("ML Model Insights — Default Risk",
     "Random Forest + Gradient Boosting ensemble trained on {loans} loans. CCC-grade accounts ({ccc} loans) carry ML-estimated default "
     "probability of {ccc_pd}%. Recommendation: Halt new CCC originations and tighten underwriting for BB-grade loans "
     "(DTI > 0.4 or LTV > 1.5)."),
    ("Early Warning — Isolation Forest Signals",
     "Isolation Forest anomaly detection flagged {high} loans as high-risk (score > 60). {shocks} loans show spending shock signals. "
     "Deploy automated SMS nudges at DPD-7 and personal outreach at DPD-15. Target: reduce DPD-30+ roll rate by 30% in 2 quarters."),
    ("K-Means Customer Segmentation",
     "K-Means (k=4) segmented portfolio into: Prime Borrowers, Growth Segment, Watch List, High Risk. "
     "Prime cluster shows lowest early warning scores — increase credit limits by 15-20%. "
     "High Risk cluster: tighten DTI ceiling to 0.35 and require additional income proof."),
    ("Pricing Optimization",
     "Current avg pricing: {price}%. Risk-adjusted floor model: Rate = Base + (PD × LGD × 100). BB/B segments appear under-priced by 2-3%. "
     "Increase BNPL originations for A-grade+ borrowers — highest risk-adj. margin."),
    ("Portfolio Diversification",
     "At-risk AUM: ₹{at_risk}Cr. Maintain SME ≤ 40% of portfolio. Grow BNPL and Unsecured Consumer segments. "
     "Partner-Fintech channel shows lowest cost of acquisition — prioritise 2:1 over Agent Network."),
]
GRADE_LINE = "{segment}: {loans} loans, AUM ₹{aum}L, actual default {default}%, ML prob {prob}%"
GEOGRAPHY_LINE = "{segment}: {loans} loans, default {default}%, ML prob {prob}%"
PRODUCT_LINE = "{segment}: {loans} loans, default {default}%, pricing {price}%"


def _filled(template: str, **figures: Column) -> Column:
    """The template with its names replaced by text columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[figures[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def benchmark_status(metrics: DataFrame) -> DataFrame:
    """ABOVE when the portfolio default rate exceeds the 8% benchmark."""
    return metrics.select(
        "defaultRate", F.lit(K.INDUSTRY_DEFAULT_BENCHMARK).alias("benchmark"),
        F.when(F.col("defaultRate") > K.INDUSTRY_DEFAULT_BENCHMARK, "ABOVE").otherwise("BELOW").alias("status"))


def _f(x: Column, digits: int) -> Column:
    """Fixed-point text of x rounded half-to-even to ``digits``."""
    return F.format_string(f"%.{digits}f", rnd(x, digits))


def _scaled(x: Column, scale: float, digits: int) -> Column:
    return _f(x.cast("double") / F.lit(scale), digits)


def _repr(x: Column) -> Column:
    """Shortest round-trip text of a double (e.g. 26.6, 30.0)."""
    return x.cast("double").cast("string")


def _grouped(n: Column) -> Column:
    return F.format_string("%,d", n.cast("long"))


def policy_facts(scored: DataFrame) -> DataFrame:
    """One row with every number the recommendations use (no row for an
    empty portfolio).

    The loans are aggregated once (:func:`reports.portfolio_rollup`, GROUPING
    SETS over the book, grades, geographies and products); a single global
    aggregate over those ~17 rows then picks the KPIs, the CCC / BB / B rows
    and the best / worst geography and product (lowest / highest default
    rate, ties to the larger AUM). One consumer of one aggregate: one scan.
    """
    r = A.portfolio_rollup(scored)
    lvl, seg = F.col("level"), F.col("segment")

    def at(level: str, c: str) -> Column:
        return F.first(F.when(lvl == level, F.col(c)), ignorenulls=True)

    def grade(g: str, c: str) -> Column:
        return F.coalesce(F.max(F.when((lvl == "grade") & (seg == g), F.col(c))), F.lit(0).cast("double"))

    def best(level: str, c: str) -> Column:
        key = F.when((lvl == level) & seg.isNotNull(), F.struct(F.col("defaultRate"), -F.col("totalDisbursed")))
        return F.min_by(F.col(c), key)

    def worst(level: str, c: str) -> Column:
        key = F.when((lvl == level) & seg.isNotNull(), F.struct(F.col("defaultRate"), F.col("totalDisbursed")))
        return F.max_by(F.col(c), key)

    metric_cols = ["totalLoans", "totalDisbursed", "avgTicketSize", "defaultRate", "delinquencyRate",
                   "avgCreditScore", "avgPricing", "totalValueProxy", "atRiskAUM", "avgDefaultProb", "avgEWScore",
                   "high", "medium", "low", "shocks"]
    source = {"totalLoans": "rows", "avgCreditScore": "avgScore"}
    m = F.struct(*[at("all", source.get(c, c)).alias(c) for c in metric_cols])

    def best_worst(level: str) -> Column:
        return F.struct(best(level, "segment").alias("best_segment"),
                        best(level, "defaultRate").alias("best_default_rate"),
                        best(level, "totalDisbursed").alias("best_aum"),
                        best(level, "avgPricing").alias("best_avg_pricing"),
                        worst(level, "segment").alias("worst_segment"),
                        worst(level, "defaultRate").alias("worst_default_rate"),
                        worst(level, "avgDefaultProb").alias("worst_avg_default_prob"))

    facts = r.agg(
        m.alias("M"), best_worst("geography").alias("GEO"), best_worst("product").alias("PROD"),
        grade("CCC", "rows").alias("ccc_count"), grade("CCC", "avgDefaultProb").alias("ccc_pd"),
        grade("BB", "rows").alias("bb_count"), grade("BB", "avgDefaultProb").alias("bb_pd"),
        grade("B", "rows").alias("b_count"), grade("B", "avgDefaultProb").alias("b_pd"),
        at("all", "rows").alias("_n"))
    return facts.where(F.col("_n").isNotNull())


def _whole(n: Column) -> Column:
    return n.cast("long").cast("string")


def _rows(facts: DataFrame, items: list[tuple[str, Column, Column]]) -> DataFrame:
    structs = [F.struct(F.lit(i + 1).alias("rank"), F.lit(t).alias("title"), typ.alias("type"), body.alias("body"))
               for i, (t, typ, body) in enumerate(items)]
    return facts.select(F.inline(F.array(*structs)))


def _parts(names: tuple[str, ...]):
    return [lambda c, n=n: F.col(f"{n}.{c}") for n in names]


def policy_recommendations(scored: DataFrame) -> DataFrame:
    """P1 (+P2 severities, P3 benchmark, P4 conditional action): six rows
    rank, title, type, body."""
    M, G, P = _parts(("M", "GEO", "PROD"))
    bench = K.INDUSTRY_DEFAULT_BENCHMARK
    grades = {f"{g}{x}": v for g in ("ccc", "bb", "b")
              for x, v in (("", _whole(F.col(f"{g}_count"))), ("_pd", _f(F.col(f"{g}_pd"), 1)))}
    bands = {c: M(c).cast("string") for c in ("high", "medium", "low", "shocks")}
    figures = [
        dict(loans=_grouped(M("totalLoans")), aum=_scaled(M("totalDisbursed"), 1e7, 2), default=_f(M("defaultRate"), 1),
             status=F.when(M("defaultRate") > bench, "ABOVE").otherwise("BELOW"), benchmark=F.lit(str(bench)),
             prob=_f(M("avgDefaultProb"), 2), score=M("avgCreditScore").cast("string"), ew=_repr(M("avgEWScore"))),
        dict(loans=_grouped(M("totalLoans")), action=F.when(F.col("ccc_count") > 0, F.lit(CCC_ACTION)).otherwise(F.lit("")), **grades),
        bands,
        dict(best=G("best_segment"), best_rate=_f(G("best_default_rate"), 1), best_aum=_scaled(G("best_aum"), 1e5, 1),
             worst=G("worst_segment"), worst_rate=_f(G("worst_default_rate"), 1), worst_pd=_f(G("worst_avg_default_prob"), 1)),
        dict(best=P("best_segment"), best_rate=_f(P("best_default_rate"), 1), best_price=_f(P("best_avg_pricing"), 1),
             worst=P("worst_segment"), worst_rate=_f(P("worst_default_rate"), 1)),
        dict(price=_f(M("avgPricing"), 2), at_risk=_scaled(M("atRiskAUM"), 1e7, 2), value=_scaled(M("totalValueProxy"), 1e7, 2)),
    ]
    by_prob = F.when(M("avgDefaultProb") > 10, "danger").when(M("avgDefaultProb") > 5, "warning").otherwise("info")
    types = [F.lit("info"), by_prob, F.lit("warning"), F.when(G("best_default_rate") < 5, "success").otherwise("info"),
             F.lit("success"), F.lit("info")]
    return _rows(policy_facts(scored), [(title, typ, _filled(text, **x)) for (title, text), typ, x in zip(RECOMMENDATIONS, types, figures)])


def policy_memo(scored: DataFrame) -> DataFrame:
    """P5: the alternate six-item memo (fixed advice, two-way severity)."""
    (M,) = _parts(("M",))
    figures = [
        dict(loans=_grouped(M("totalLoans")), aum=_scaled(M("totalDisbursed"), 1e7, 1), prob=_f(M("avgDefaultProb"), 1),
             default=_repr(M("defaultRate")), side=F.when(M("defaultRate") > 8, "above").otherwise("below"), ew=_repr(M("avgEWScore"))),
        dict(loans=_grouped(M("totalLoans")), ccc=_whole(F.col("ccc_count")), ccc_pd=_f(F.col("ccc_pd"), 1)),
        dict(high=M("high").cast("string"), shocks=M("shocks").cast("string")),
        {}, dict(price=_repr(M("avgPricing"))), dict(at_risk=_scaled(M("atRiskAUM"), 1e7, 1)),
    ]
    types = [F.lit("info"), F.when(M("avgDefaultProb") > 10, "danger").otherwise("info"), F.lit("warning"), F.lit("success"),
             F.lit("info"), F.lit("info")]
    return _rows(policy_facts(scored), [(title, typ, _filled(text, **x)) for (title, text), typ, x in zip(MEMO, types, figures)])


def segment_summaries(scored: DataFrame) -> DataFrame:
    """One text line per non-empty grade, per geography, per product
    (all three from one GROUPING SETS aggregate of the loans)."""
    r = A.portfolio_rollup(scored)
    lvl, seg = F.col("level"), F.col("segment")
    default, prob = _f(F.col("defaultRate"), 1), _f(F.col("avgDefaultProb"), 1)
    grade = _filled(GRADE_LINE, segment=seg, loans=F.col("rows").cast("string"), aum=_scaled(F.col("totalDisbursed"), 1e5, 1),
                    default=default, prob=prob)
    geo = _filled(GEOGRAPHY_LINE, segment=seg, loans=F.col("count").cast("string"), default=default, prob=prob)
    prod = _filled(PRODUCT_LINE, segment=seg, loans=F.col("count").cast("string"), default=default, price=_f(F.col("avgPricing"), 1))
    keep = (((lvl == "grade") & seg.isin(K.GRADES) & (F.col("rows") > 0))
            | (lvl.isin("geography", "product") & seg.isNotNull()))
    return r.where(keep).select(
        F.when(lvl == "product", "product").otherwise(lvl).alias("dimension"), seg.alias("segment"),
        F.when(lvl == "grade", grade).when(lvl == "geography", geo).otherwise(prod).alias("line"))
