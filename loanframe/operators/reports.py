"""Aggregate reports over scored loans.

Every report is one declarative aggregate. Group keys are low-cardinality
(segments, grades, cohorts, clusters, buckets), so Spark's partial (map-side)
aggregation reduces each input partition to a handful of rows before the
shuffle: the exchange carries O(partitions x groups) rows whatever the
table size, and a hot key (one segment holding a third of the loans) costs
no more than any other. Joins only ever meet a literal dimension of fixed
size (the 7-grade spine, the 5 buckets), which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import (WIDE, exact_mean, ew_bucket, grade_tier, int_mean, rate_pct, rnd,
                         trunc_long, wide_mean, wide_total)
from . import ranks
from .scoring import grade_pd, rule_pd_raw

# Decimal shapes: scores are already rounded to theirs, uploaded values keep all their decimals.
PRICE = WIDE
PROB = (9, 4)
EW = (9, 1)


def _avg(c: str, shape) -> Column:
    return exact_mean(c, *shape)


def _delinquent() -> Column:
    return (F.col("delinquency_status") != "Current").cast("int")


def _spine(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A tiny literal dimension (fixed size) with its display order, as an
    inline table so the planner knows it is a handful of rows."""
    rows = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias("_ord")) for i, v in enumerate(values)])
    return spark.range(1).select(F.inline(rows))


def _dense(spine: DataFrame, agg: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join of a literal spine to an aggregate keyed by a categorical
    column. Only keys on the spine can match, so the aggregate is cut to
    them first: the broadcast side then holds at most ``len(values)`` rows
    whatever the data (and the filter on the grouping key reaches below the
    aggregate). The spine is the preserved (streamed) side."""
    return spine.join(F.broadcast(agg.where(F.col(key).isin(values))), key, "left")


# ---------------------------------------------------------------------------
# A1 portfolio KPIs
# ---------------------------------------------------------------------------
def portfolio_metrics(scored: DataFrame) -> DataFrame:
    """A1: one row of KPIs; no row at all for an empty portfolio."""
    at_risk = wide_total(F.when(F.col("loan_status") != "Active", F.col("loan_size")))
    return (scored.agg(
        F.count(F.lit(1)).alias("totalLoans"),
        wide_total("loan_size").alias("totalDisbursed"),
        trunc_long(wide_mean("loan_size")).alias("avgTicketSize"),
        rate_pct(F.col("default_indicator")).alias("defaultRate"),
        rate_pct(_delinquent()).alias("delinquencyRate"),
        trunc_long(wide_mean("credit_score")).alias("avgCreditScore"),
        rnd(_avg("pricing_rate", PRICE), 2).alias("avgPricing"),
        wide_total("value_proxy").alias("totalValueProxy"),
        F.coalesce(at_risk, F.lit(0).cast("long")).alias("atRiskAUM"),
        rnd(_avg("default_prob", PROB) * F.lit(100.0), 2).alias("avgDefaultProb"),
        rnd(_avg("early_warning_score", EW), 1).alias("avgEWScore"),
    ).where(F.col("totalLoans") > 0))


# ---------------------------------------------------------------------------
# A2 segment breakdown (and its derivatives)
# ---------------------------------------------------------------------------
def _segment_aggs() -> list[Column]:
    return [
        F.count("loan_id").alias("count"),
        wide_total("loan_size").alias("totalDisbursed"),
        rate_pct(F.col("default_indicator")).alias("defaultRate"),
        trunc_long(wide_mean("credit_score")).alias("avgScore"),
        rnd(_avg("pricing_rate", PRICE), 2).alias("avgPricing"),
        rnd(_avg("default_prob", PROB) * F.lit(100.0), 2).alias("avgDefaultProb"),
    ]


SEGMENT_COLUMNS = ["segment", "count", "totalDisbursed", "defaultRate", "avgScore", "avgPricing", "avgDefaultProb"]


def segment_breakdown(scored: DataFrame, key: str) -> DataFrame:
    """A2: per-segment KPIs for any column; NULL keys are dropped; AUM desc.

    A column that does not exist gives an empty report with the same schema.
    """
    if key not in scored.columns:
        return scored.sparkSession.createDataFrame(
            [], "segment string, count bigint, totalDisbursed bigint, defaultRate double, avgScore bigint, "
                "avgPricing double, avgDefaultProb double")
    return (scored.where(F.col(key).isNotNull())
            .groupBy(F.col(key).cast("string").alias("segment"))
            .agg(*_segment_aggs())
            .orderBy(F.col("totalDisbursed").desc(), F.col("segment")))


def pricing_report(scored: DataFrame) -> DataFrame:
    """Product and grade breakdowns in one pass.

    Loans are aggregated by both keys once; the two breakdowns are rolled up
    from those few rows (see :func:`_rolled_up`).
    """
    agg = _rolled_up(scored, ["product_type", "credit_quality"], [["product_type"], ["credit_quality"]])
    # grouping_id bit set = column NOT grouped; product_type is the high bit.
    product = F.col("_gid") == 1
    out = agg.select(
        F.when(product, F.lit("products")).otherwise(F.lit("grades")).alias("dimension"),
        F.when(product, F.col("product_type")).otherwise(F.col("credit_quality")).alias("segment"),
        F.col("_nid").alias("count"), F.col("_aum").cast("long").alias("totalDisbursed"),
        rnd(_ratio("_d", "_dn") * F.lit(100.0), 1).alias("defaultRate"),
        trunc_long(_ratio("_cs", "_csn")).alias("avgScore"),
        rnd(_ratio("_pr", "_prn"), 2).alias("avgPricing"),
        rnd(_ratio("_pd", "_pdn") * F.lit(100.0), 2).alias("avgDefaultProb"))
    return out.where(F.col("segment").isNotNull()).orderBy("dimension", F.col("totalDisbursed").desc())


def product_share(scored: DataFrame) -> DataFrame:
    """AUM share per product (donut). The window runs over the
    aggregated segments only (a few rows), never over loans."""
    seg = segment_breakdown(scored, "product_type").select("segment", "totalDisbursed")
    total = F.sum("totalDisbursed").over(Window.partitionBy())
    return seg.withColumn("share", F.col("totalDisbursed").cast("double") / total.cast("double"))


def product_profitability(scored: DataFrame) -> DataFrame:
    """Revenue proxy = count * avgPricing * 1000, by avgPricing desc."""
    seg = segment_breakdown(scored, "product_type")
    return (seg.select("segment", "count", "totalDisbursed", "defaultRate", "avgDefaultProb", "avgPricing",
                       (F.col("count").cast("double") * F.col("avgPricing") * F.lit(1000.0)).alias("revenueProxy"))
            .orderBy(F.col("avgPricing").desc(), F.col("segment")))


def best_worst(scored: DataFrame, key: str) -> DataFrame:
    """Lowest and highest default-rate segment; ties go to the larger AUM
    (the report is in AUM-descending order and the first one wins)."""
    seg = segment_breakdown(scored, key)
    return seg.agg(
        F.min_by("segment", F.struct(F.col("defaultRate"), -F.col("totalDisbursed"))).alias("best_segment"),
        F.min("defaultRate").alias("best_default_rate"),
        F.min_by("totalDisbursed", F.struct(F.col("defaultRate"), -F.col("totalDisbursed"))).alias("best_aum"),
        F.max_by("segment", F.struct(F.col("defaultRate"), F.col("totalDisbursed"))).alias("worst_segment"),
        F.max("defaultRate").alias("worst_default_rate"),
        F.max_by("avgDefaultProb", F.struct(F.col("defaultRate"), F.col("totalDisbursed")))
        .alias("worst_avg_default_prob"),
    ).where(F.col("best_segment").isNotNull())


def roi_best_worst(scored: DataFrame) -> DataFrame:
    """Product ROI score = avgPricing - 2 * defaultRate; best and worst
    product (first in AUM order wins ties) and their first word."""
    seg = segment_breakdown(scored, "product_type").withColumn(
        "roi", F.col("avgPricing") - F.col("defaultRate") * F.lit(2.0))
    return seg.agg(
        F.max_by("segment", F.struct(F.col("roi"), F.col("totalDisbursed"))).alias("best_product"),
        F.max("roi").alias("best_roi"),
        F.min_by("segment", F.struct(F.col("roi"), -F.col("totalDisbursed"))).alias("worst_product"),
        F.min("roi").alias("worst_roi"),
    ).where(F.col("best_product").isNotNull()).select(
        "*", F.split("best_product", " ").getItem(0).alias("best_label"),
        F.split("worst_product", " ").getItem(0).alias("worst_label"))


# ---------------------------------------------------------------------------
# A3 risk distribution over the dense grade spine (J2) and derivatives
# ---------------------------------------------------------------------------
def risk_distribution(scored: DataFrame) -> DataFrame:
    """A3: every grade appears (zero-filled); one aggregate, then a join to the
    7-row literal spine."""
    agg = (scored.groupBy(F.col("credit_quality").alias("grade")).agg(
        F.count(F.lit(1)).alias("_n"),
        wide_total("loan_size").alias("_aum"),
        rate_pct(F.col("default_indicator")).alias("_dr"),
        rnd(_avg("default_prob", PROB) * F.lit(100.0), 2).alias("_pd")))
    spine = _spine(scored.sparkSession, "grade", K.GRADES)
    return (_dense(spine, agg, "grade", K.GRADES).select(
        "grade",
        F.coalesce("_n", F.lit(0).cast("long")).alias("count"),
        F.coalesce("_aum", F.lit(0).cast("long")).alias("aum"),
        F.coalesce("_dr", F.lit(0.0)).alias("defaultRate"),
        F.coalesce("_pd", F.lit(0.0)).alias("avgDefaultProb"),
        "_ord").orderBy("_ord").drop("_ord"))


def nonempty_grades(scored: DataFrame) -> DataFrame:
    """grades with at least one loan."""
    return risk_distribution(scored).where(F.col("count") > 0)


def grade_tiers(scored: DataFrame) -> DataFrame:
    """A10: Investment (AAA-BBB), Speculative (BB-B), Distressed (CCC) counts."""
    rd = risk_distribution(scored).withColumn("tier", grade_tier("grade"))
    spine = _spine(scored.sparkSession, "tier", K.TIER_ORDER)
    agg = rd.groupBy("tier").agg(F.sum("count").alias("count"), F.sum("aum").alias("aum"))
    return _dense(spine, agg, "tier", K.TIER_ORDER).orderBy("_ord").select(
        "tier", F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        F.coalesce("aum", F.lit(0).cast("long")).alias("aum"))


def pricing_by_grade(scored: DataFrame) -> DataFrame:
    """Average pricing on the full grade ladder, missing grades -> 0."""
    seg = segment_breakdown(scored, "credit_quality").select(F.col("segment").alias("grade"), "avgPricing")
    spine = _spine(scored.sparkSession, "grade", K.GRADES)
    return (_dense(spine, seg, "grade", K.GRADES).orderBy("_ord")
            .select("grade", F.coalesce("avgPricing", F.lit(0.0)).alias("avgPricing")))


def grade_lookup_join(loans: DataFrame) -> DataFrame:
    """Per loan, the rule PD of its grade from the literal grade table
    (unknown grade -> fallback). Expressed as a literal-map lookup, i.e. a
    broadcast dimension join folded into the projection."""
    return loans.select("loan_id", "credit_quality", grade_pd("credit_quality").alias("grade_pd"))


# ---------------------------------------------------------------------------
# A4 cohorts, A5/A6 early-warning distribution, A7 clusters, A8 scatter
# ---------------------------------------------------------------------------
def cohort_analysis(scored: DataFrame) -> DataFrame:
    """A4: per 6-month vintage, in cohort (string) order; empty without a cohort column."""
    if "cohort" not in scored.columns:
        return scored.sparkSession.createDataFrame(
            [], "cohort string, loans bigint, defaultRate double, delinqRate double, avgPricing double, "
                "valueCreated bigint, avgEWScore double")
    return (scored.where(F.col("cohort").isNotNull()).groupBy("cohort").agg(
        F.count("loan_id").alias("loans"),
        rate_pct(F.col("default_indicator")).alias("defaultRate"),
        rate_pct(_delinquent()).alias("delinqRate"),
        rnd(_avg("pricing_rate", PRICE), 2).alias("avgPricing"),
        wide_total("value_proxy").alias("valueCreated"),
        rnd(_avg("early_warning_score", EW), 1).alias("avgEWScore"),
    ).orderBy("cohort"))


def ew_bands(scored: DataFrame) -> DataFrame:
    """A5: high (> 60), medium (40..60 inclusive), low (< 40), shocks; all loans."""
    s = F.col("early_warning_score")
    return scored.agg(
        F.count_if(s > 60).alias("high"),
        F.count_if((s >= 40) & (s <= 60)).alias("medium"),
        F.count_if(s < 40).alias("low"),
        F.coalesce(F.sum(F.col("spending_shock").cast("long")), F.lit(0).cast("long")).alias("shocks"),
    )


def ew_buckets(scored: DataFrame) -> DataFrame:
    """Histogram 0-20 .. 80-100, zero-filled, in one pass: one conditional
    count per bucket (partial counts per task, a single row through the
    exchange), then the five counts laid out as rows in bucket order."""
    b = ew_bucket("early_warning_score")
    counts = scored.agg(*[F.count_if(b == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(K.EW_BUCKETS)])
    rows = F.array(*[F.struct(F.lit(v).alias("bucket"), F.col(f"_c{i}").alias("count"))
                     for i, v in enumerate(K.EW_BUCKETS)])
    return counts.select(F.inline(rows))


def cluster_profiles(scored: DataFrame) -> DataFrame:
    """Per cluster KPIs, named by risk rank (lowest avg EW = first name),
    in avgEWScore order; empty without a cluster column. The ranking window runs over k rows."""
    if "cluster" not in scored.columns:
        return scored.sparkSession.createDataFrame(
            [], "cluster int, name string, count bigint, avgCreditScore bigint, avgPricing double, "
                "defaultRate double, avgEWScore double, totalAUM bigint")
    agg = scored.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"),
        trunc_long(wide_mean("credit_score")).alias("avgCreditScore"),
        rnd(_avg("pricing_rate", PRICE), 2).alias("avgPricing"),
        rate_pct(F.col("default_indicator")).alias("defaultRate"),
        rnd(_avg("early_warning_score", EW), 1).alias("avgEWScore"),
        wide_total("loan_size").alias("totalAUM"),
    )
    rank = F.row_number().over(Window.partitionBy().orderBy("avgEWScore", "cluster")) - 1
    names = F.array(*[F.lit(n) for n in K.CLUSTER_NAMES])
    named = agg.withColumn("_rank", rank).withColumn(
        "name", F.when(F.col("_rank") < len(K.CLUSTER_NAMES), F.element_at(names, (F.col("_rank") + 1).cast("int")))
        .otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))))
    return named.orderBy("_rank").select("cluster", "name", "count", "avgCreditScore", "avgPricing",
                                          "defaultRate", "avgEWScore", "totalAUM")


def ew_quartile_clusters(scored: DataFrame) -> DataFrame:
    """Deterministic stand-in clustering for rule mode: EW quartile band 0..3."""
    return scored.withColumn(
        "cluster", F.least(F.floor(F.col("early_warning_score") / F.lit(25.0)), F.lit(3)).cast("int"))


def scatter_data(scored: DataFrame, x: str = "credit_score", y: str = "default_prob",
                 group: str = "credit_quality") -> DataFrame:
    """Label, mean x (unrounded), mean y (x100 for default_prob, 2dp), count."""
    ym = F.avg(F.col(y).cast("double"))
    if y == "default_prob":
        ym = rnd(_avg(y, PROB) * F.lit(100.0), 2)
    else:
        ym = rnd(ym, 2)
    xm = wide_mean(x) if x in ("credit_score", "loan_size", "income_proxy") else F.avg(F.col(x).cast("double"))
    return (scored.where(F.col(group).isNotNull())
            .groupBy(F.col(group).cast("string").alias("label"))
            .agg(xm.alias("x"), ym.alias("y"), F.count("loan_id").alias("r")))


def scatter_bubbles(scatter: DataFrame) -> DataFrame:
    """A8 with the radius of each bubble: 1.2 times the root of its loans (one, if there are none)."""
    loans = F.when(F.coalesce(F.col("r"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("r"))
    return scatter.withColumn("radius", F.sqrt(loans.cast("double")) * F.lit(1.2))


def segments_present(scored: DataFrame, keys: list[str]) -> DataFrame:
    """the breakdowns by several columns in one table; a column that does not exist adds no rows."""
    parts = [segment_breakdown(scored, k).withColumn("dimension", F.lit(k)) for k in keys]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# M9 predicted grades against the grades there are
# ---------------------------------------------------------------------------
def grade_confusion(predicted: DataFrame) -> DataFrame:
    """Loans by grade and predicted grade (pairs that occur)."""
    return predicted.groupBy("credit_quality", "predicted_grade").agg(F.count(F.lit(1)).alias("count"))


def grade_accuracy(predicted: DataFrame) -> DataFrame:
    """One row: loans, those whose predicted grade is their grade, and the share (4 decimals)."""
    right = F.count_if(F.col("credit_quality") == F.col("predicted_grade"))
    return predicted.agg(F.count(F.lit(1)).alias("n"), right.alias("correct")).select(
        "n", "correct", rnd(F.col("correct").cast("double") / F.col("n"), 4).alias("accuracy"))


# ---------------------------------------------------------------------------
# A14 AUC, A15 distinct counts, S5/S6 load summaries
# ---------------------------------------------------------------------------
def auc(df: DataFrame, score: str, label: str = "default_indicator", decimals: int = 4) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney, ties half-credited) of a rounded score; 0 with one class.

    The score is rounded to ``decimals`` first, so the data collapse to at
    most 10**decimals + 1 distinct scores in [0, 1] before the one ordered
    (unpartitioned) window: that window sees a bounded table, whatever the
    number of loans. :func:`ranks.auc` takes unrounded scores.
    """
    s = rnd(F.col(score), decimals)
    per = df.groupBy(s.alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    return auc_of_counts(per)


def auc_of_counts(per: DataFrame) -> DataFrame:
    """AUC from positives and negatives counted per distinct score (s, pos, neg), a bounded table."""
    w = Window.partitionBy().orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return ranks.auc_of_counts(per.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0).cast("long"))))


def auc_rule(loans: DataFrame) -> DataFrame:
    """AUC of the rule PD without the default override (R(4) scores)."""
    return auc(loans.withColumn("_score", rnd(rule_pd_raw(), 4)), "_score")


def auc_rule_unrounded(loans: DataFrame) -> DataFrame:
    """AUC of the rule PD as it is, by distributed ranks."""
    return ranks.auc(loans.select(rule_pd_raw().alias("_score"), "default_indicator"), "_score", "default_indicator")


def score_ranks(loans: DataFrame) -> DataFrame:
    """Each distinct unrounded rule PD with its loans and their average rank."""
    return ranks.average_ranks(loans.select(rule_pd_raw().alias("rule_pd")), "rule_pd").withColumnRenamed("score", "rule_pd")


def distinct_grades(loans: DataFrame) -> DataFrame:
    """Distinct grade values present."""
    return loans.select(F.col("credit_quality").alias("grade")).where(F.col("grade").isNotNull()).distinct()


def class_counts(loans: DataFrame) -> DataFrame:
    """Number of distinct grades and of label classes."""
    return loans.agg(F.countDistinct("credit_quality").alias("n_grades"),
                     F.countDistinct("default_indicator").alias("n_label_classes"))


def load_summary(loans: DataFrame) -> DataFrame:
    """Upload summary; grades as a sorted comma-joined list (bounded: the
    normaliser maps grades onto the 7-letter ladder)."""
    return loans.agg(
        F.count(F.lit(1)).alias("total_loans"),
        rate_pct(F.col("default_indicator")).alias("default_rate"),
        trunc_long(wide_mean("credit_score")).alias("avg_credit_score"),
        wide_total("loan_size").alias("total_aum"),
        F.array_join(F.array_sort(F.collect_set("credit_quality")), ",").alias("grades_found"),
    ).where(F.col("total_loans") > 0)


def status_counts(loans: DataFrame) -> DataFrame:
    """loan_status value counts plus the defaulted total."""
    return loans.groupBy("loan_status").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("default_indicator").cast("long")).alias("defaults"))


# ---------------------------------------------------------------------------
# F1 active-or-all
# ---------------------------------------------------------------------------
def active_or_all(scored: DataFrame) -> DataFrame:
    """Active loans, or every loan when none is Active.

    The fallback is a scalar subquery that stops at the first Active loan.
    It reads ``scored`` a second time, so hand in a stored table when that is
    an expensive plan.
    """
    any_active = scored.where(F.col("loan_status") == "Active").select(F.lit(1)).limit(1).exists()
    return scored.where((F.col("loan_status") == "Active") | ~any_active)


# ---------------------------------------------------------------------------
# Two-stage rollup for reports that need several groupings at once
# ---------------------------------------------------------------------------
ROLLUP_LEVELS = {"all": [], "grade": ["credit_quality"], "geography": ["geography"], "product": ["product_type"]}


def _partials() -> list[Column]:
    """Additive aggregates (counts and exact DECIMAL / BIGINT sums)."""
    ew = F.col("early_warning_score")
    wide = "decimal({},{})".format(*WIDE)
    size = F.col("loan_size").cast(wide)
    return [
        F.count(F.lit(1)).alias("_n"), F.count("loan_id").alias("_nid"),
        F.sum(size).alias("_aum"), F.count("loan_size").alias("_aumn"),
        F.sum(F.col("default_indicator").cast("long")).alias("_d"), F.count("default_indicator").alias("_dn"),
        F.sum(_delinquent().cast("long")).alias("_q"), F.count("delinquency_status").alias("_qn"),
        F.sum(F.col("credit_score").cast(wide)).alias("_cs"), F.count("credit_score").alias("_csn"),
        F.sum(F.col("pricing_rate").cast(wide)).alias("_pr"), F.count("pricing_rate").alias("_prn"),
        F.sum(F.col("value_proxy").cast(wide)).alias("_vp"),
        F.sum(F.when(F.col("loan_status") != "Active", size)).alias("_ar"),
        F.sum(F.col("default_prob").cast("decimal(9,4)")).alias("_pd"), F.count("default_prob").alias("_pdn"),
        F.sum(ew.cast("decimal(9,1)")).alias("_ew"), F.count(ew).alias("_ewn"),
        F.count_if(ew > 60).alias("_hi"), F.count_if((ew >= 40) & (ew <= 60)).alias("_me"),
        F.count_if(ew < 40).alias("_lo"), F.sum(F.col("spending_shock").cast("long")).alias("_sh"),
    ]


PARTIALS = ["_n", "_nid", "_aum", "_aumn", "_d", "_dn", "_q", "_qn", "_cs", "_csn", "_pr", "_prn", "_vp", "_ar", "_pd",
            "_pdn", "_ew", "_ewn", "_hi", "_me", "_lo", "_sh"]


def _rolled_up(scored: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """The partials of several groupings, and their ``_gid``.

    Loans are aggregated by all ``keys`` first (a few hundred rows of
    low-cardinality segments); the grouping sets expand those rows, not loans.
    """
    fine = scored.groupBy(*keys).agg(*_partials())
    return fine.groupingSets([[F.col(k) for k in cols] for cols in sets], *[F.col(k) for k in keys]).agg(
        *[F.sum(c).alias(c) for c in PARTIALS], F.grouping_id().alias("_gid"))


def _ratio(s: str, n: str) -> Column:
    return F.col(s).cast("double") / F.col(n).cast("double")


def portfolio_rollup(scored: DataFrame) -> DataFrame:
    """KPIs for the whole book, per grade, per geography and per product from
    ONE aggregate over the loans, rolled up to the four levels afterwards.

    Output: level ('all' | 'grade' | 'geography' | 'product'), segment, and
    the finished KPI columns of A1 / A2 / A3 / A5 for that level.
    """
    gs = _rolled_up(scored, ["credit_quality", "geography", "product_type"], list(ROLLUP_LEVELS.values()))
    # grouping_id bit = 1 when the column is NOT grouped; credit_quality is the high bit.
    level = (F.when(F.col("_gid") == 7, "all").when(F.col("_gid") == 3, "grade")
             .when(F.col("_gid") == 5, "geography").otherwise("product"))
    seg = (F.when(F.col("_gid") == 3, F.col("credit_quality")).when(F.col("_gid") == 5, F.col("geography"))
           .when(F.col("_gid") == 6, F.col("product_type")))
    return gs.select(
        level.alias("level"), seg.cast("string").alias("segment"),
        F.col("_n").alias("rows"), F.col("_nid").alias("count"), F.col("_aum").cast("long").alias("totalDisbursed"),
        trunc_long(_ratio("_aum", "_aumn")).alias("avgTicketSize"),
        rnd(_ratio("_d", "_dn") * F.lit(100.0), 1).alias("defaultRate"),
        rnd(_ratio("_q", "_qn") * F.lit(100.0), 1).alias("delinquencyRate"),
        trunc_long(_ratio("_cs", "_csn")).alias("avgScore"),
        rnd(_ratio("_pr", "_prn"), 2).alias("avgPricing"),
        F.col("_vp").cast("long").alias("totalValueProxy"),
        F.coalesce(F.col("_ar").cast("long"), F.lit(0).cast("long")).alias("atRiskAUM"),
        rnd(_ratio("_pd", "_pdn") * F.lit(100.0), 2).alias("avgDefaultProb"),
        rnd(_ratio("_ew", "_ewn"), 1).alias("avgEWScore"),
        F.col("_hi").alias("high"), F.col("_me").alias("medium"), F.col("_lo").alias("low"),
        F.coalesce(F.col("_sh"), F.lit(0).cast("long")).alias("shocks"))
