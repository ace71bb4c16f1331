"""DuckDB oracle statement per checked plan name."""

from __future__ import annotations

from . import oracle_values as K
from .oracle import (CLIP, EW_BASE, R, RULE_EW, RULE_PD, RULE_PD_RAW, SEGMENT_AGGS, big, dmean, imean,
                     itrunc, q, segment_sql, segments_query, with_loans, with_scored)

ORACLE: dict[str, str] = {}

for _name, _key in [("segments_geography", "geography"), ("segments_employment", "employment_type"),
                    ("segments_product", "product_type"), ("segments_channel", "acquisition_channel"),
                    ("segments_grade", "credit_quality")]:
    ORACLE[_name] = segments_query(_key)


def _values(name: str, values: list[str], alias: str) -> str:
    rows = ", ".join(f"({q(v)}, {i})" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS {alias}({name}, ord)"


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------
ORACLE["scored_loans"] = with_scored("SELECT * FROM scored")
ORACLE["rule_default_prob"] = with_loans(
    f"SELECT loan_id, {R(RULE_PD_RAW, 4)} AS rule_pd, {RULE_PD} AS default_prob FROM loans")
ORACLE["rule_ew_score"] = with_loans(f"SELECT loan_id, {RULE_EW} AS early_warning_score FROM loans")
ORACLE["ew_blend"] = with_loans(
    f"SELECT loan_id, {R(CLIP(EW_BASE, '0e0', '100e0') + ' * 0.6e0 + ' + RULE_PD + ' * 100e0 * 0.4e0', 1)}"
    " AS ew_blend FROM loans")
ORACLE["risk_level"] = with_scored(
    "SELECT loan_id, early_warning_score, CASE WHEN early_warning_score > 60 THEN 'High' "
    "WHEN early_warning_score > 40 THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored")
ORACLE["segment_bands"] = with_scored(f""", seg AS ({segment_sql('geography')})
SELECT *,
  CASE WHEN "defaultRate" > 15 THEN 'danger' WHEN "defaultRate" > 8 THEN 'warning' ELSE 'success' END AS "defaultBand",
  CASE WHEN "defaultRate" > 12 THEN 'danger' WHEN "defaultRate" > 7 THEN 'warning' ELSE 'success' END AS "cohortBand",
  CASE WHEN "defaultRate" > 12 THEN 'danger' ELSE 'warning' END AS "pricingBand"
FROM seg""")
ORACLE["score_guard"] = with_scored(f"""
SELECT {R('s', 6)} AS prob_std, CASE WHEN s < {K.PROB_STD_FLOOR}e0 THEN 'rules' ELSE 'model' END AS branch
FROM (SELECT stddev_pop(default_prob) AS s FROM scored)""")

# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
ORACLE["portfolio_metrics"] = with_scored(f"""
SELECT * FROM (
  SELECT count(*) AS "totalLoans",
    {big('sum(loan_size)')} AS "totalDisbursed",
    {itrunc(imean('loan_size'))} AS "avgTicketSize",
    {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
    {R("CAST(sum(CASE WHEN delinquency_status <> 'Current' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 1e2", 1)}
      AS "delinquencyRate",
    {itrunc(imean('credit_score'))} AS "avgCreditScore",
    {R(dmean('pricing_rate', 9, 2), 2)} AS "avgPricing",
    {itrunc('CAST(sum(CAST(value_proxy AS DECIMAL(18,2))) AS DOUBLE)')} AS "totalValueProxy",
    {big("coalesce(sum(CASE WHEN loan_status <> 'Active' THEN loan_size END), 0)")} AS "atRiskAUM",
    {R(dmean('default_prob', 9, 4) + ' * 1e2', 2)} AS "avgDefaultProb",
    {R(dmean('early_warning_score', 9, 1), 1)} AS "avgEWScore"
  FROM scored) WHERE "totalLoans" > 0""")

_GRADE_AGG = f"""agg AS (
  SELECT credit_quality AS grade, count(*) AS n, {big('sum(loan_size)')} AS aum,
    {R(imean('default_indicator') + ' * 1e2', 1)} AS dr,
    {R(dmean('default_prob', 9, 4) + ' * 1e2', 2)} AS pd
  FROM scored GROUP BY credit_quality)"""
_RISK_DIST = f"""rd AS (
  SELECT g.grade, coalesce(a.n, 0) AS "count", coalesce(a.aum, 0) AS aum,
    coalesce(a.dr, 0e0) AS "defaultRate", coalesce(a.pd, 0e0) AS "avgDefaultProb"
  FROM {_values('grade', K.GRADES, 'g')} LEFT JOIN agg a ON a.grade = g.grade)"""
ORACLE["risk_distribution"] = with_scored(f", {_GRADE_AGG}, {_RISK_DIST} SELECT * FROM rd")
ORACLE["nonempty_grades"] = with_scored(f", {_GRADE_AGG}, {_RISK_DIST} SELECT * FROM rd WHERE \"count\" > 0")
_TIER_CASE = ("CASE WHEN grade IN ('AAA','AA','A','BBB') THEN 'Investment' WHEN grade IN ('BB','B') "
              "THEN 'Speculative' WHEN grade = 'CCC' THEN 'Distressed' END")
ORACLE["grade_tiers"] = with_scored(f""", {_GRADE_AGG}, {_RISK_DIST},
t AS (SELECT {_TIER_CASE} AS tier, sum("count") AS c, sum(aum) AS a FROM rd GROUP BY 1)
SELECT s.tier, {big('coalesce(t.c, 0)')} AS "count", {big('coalesce(t.a, 0)')} AS aum
FROM {_values('tier', K.TIER_ORDER, 's')} LEFT JOIN t ON t.tier = s.tier""")
ORACLE["pricing_by_grade"] = with_scored(f""", seg AS ({segment_sql('credit_quality')})
SELECT g.grade, coalesce(seg."avgPricing", 0e0) AS "avgPricing"
FROM {_values('grade', K.GRADES, 'g')} LEFT JOIN seg ON seg.segment = g.grade""")

ORACLE["cohort_analysis"] = with_scored(f"""
SELECT cohort, count(loan_id) AS loans,
  {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
  {R("CAST(sum(CASE WHEN delinquency_status <> 'Current' THEN 1 ELSE 0 END) AS DOUBLE) / count(delinquency_status) * 1e2", 1)} AS "delinqRate",
  {R(dmean('pricing_rate', 9, 2), 2)} AS "avgPricing",
  {itrunc('CAST(sum(CAST(value_proxy AS DECIMAL(18,2))) AS DOUBLE)')} AS "valueCreated",
  {R(dmean('early_warning_score', 9, 1), 1)} AS "avgEWScore"
FROM scored WHERE cohort IS NOT NULL GROUP BY cohort""")

ORACLE["ew_bands"] = with_scored("""
SELECT count(*) FILTER (WHERE early_warning_score > 60) AS high,
  count(*) FILTER (WHERE early_warning_score >= 40 AND early_warning_score <= 60) AS medium,
  count(*) FILTER (WHERE early_warning_score < 40) AS low,
  CAST(coalesce(sum(spending_shock), 0) AS BIGINT) AS shocks
FROM scored""")

ORACLE["ew_buckets"] = with_scored(f""", b AS (
  SELECT CASE WHEN early_warning_score >= 0 AND early_warning_score < 20 THEN '0-20'
    WHEN early_warning_score >= 20 AND early_warning_score < 40 THEN '20-40'
    WHEN early_warning_score >= 40 AND early_warning_score < 60 THEN '40-60'
    WHEN early_warning_score >= 60 AND early_warning_score < 80 THEN '60-80'
    WHEN early_warning_score >= 80 AND early_warning_score <= 100 THEN '80-100' END AS bucket
  FROM scored),
c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket)
SELECT s.bucket, coalesce(c.n, 0) AS "count" FROM {_values('bucket', K.EW_BUCKETS, 's')} LEFT JOIN c ON c.bucket = s.bucket""")

_NAMES = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(K.CLUSTER_NAMES))
ORACLE["cluster_profiles_rule"] = with_scored(f""", cl AS (
  SELECT *, least(CAST(floor(early_warning_score / 25e0) AS INTEGER), 3) AS cl FROM scored),
p AS (
  SELECT cl AS cluster, count(*) AS "count", {itrunc(imean('credit_score'))} AS "avgCreditScore",
    {R(dmean('pricing_rate', 9, 2), 2)} AS "avgPricing",
    {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
    {R(dmean('early_warning_score', 9, 1), 1)} AS "avgEWScore",
    {big('sum(loan_size)')} AS "totalAUM"
  FROM cl GROUP BY cl),
r AS (SELECT *, row_number() OVER (ORDER BY "avgEWScore", cluster) - 1 AS rk FROM p)
SELECT cluster, CASE rk {_NAMES} ELSE 'Cluster ' || CAST(cluster AS VARCHAR) END AS name,
  "count", "avgCreditScore", "avgPricing", "defaultRate", "avgEWScore", "totalAUM" FROM r""")

ORACLE["scatter_grade"] = with_scored(f"""
SELECT CAST(credit_quality AS VARCHAR) AS label, {imean('credit_score')} AS x,
  {R(dmean('default_prob', 9, 4) + ' * 1e2', 2)} AS y, count(loan_id) AS r
FROM scored WHERE credit_quality IS NOT NULL GROUP BY credit_quality""")

ORACLE["pricing_report"] = with_scored(f"""
SELECT 'products' AS dimension, * FROM ({segment_sql('product_type')})
UNION ALL
SELECT 'grades' AS dimension, * FROM ({segment_sql('credit_quality')})""")

ORACLE["product_share"] = with_scored(f""", seg AS ({segment_sql('product_type')})
SELECT segment, "totalDisbursed",
  CAST("totalDisbursed" AS DOUBLE) / CAST(sum("totalDisbursed") OVER () AS DOUBLE) AS share FROM seg""")

ORACLE["product_profitability"] = with_scored(f""", seg AS ({segment_sql('product_type')})
SELECT segment, "count", "totalDisbursed", "defaultRate", "avgDefaultProb", "avgPricing",
  CAST("count" AS DOUBLE) * "avgPricing" * 1000e0 AS "revenueProxy" FROM seg""")

ORACLE["roi_best_worst"] = with_scored(f""", seg AS (
  SELECT *, "avgPricing" - "defaultRate" * 2e0 AS roi FROM ({segment_sql('product_type')})),
b AS (SELECT segment, roi FROM seg ORDER BY roi DESC, "totalDisbursed" DESC LIMIT 1),
w AS (SELECT segment, roi FROM seg ORDER BY roi ASC, "totalDisbursed" DESC LIMIT 1)
SELECT b.segment AS best_product, b.roi AS best_roi, w.segment AS worst_product, w.roi AS worst_roi,
  split_part(b.segment, ' ', 1) AS best_label, split_part(w.segment, ' ', 1) AS worst_label
FROM b, w""")


def _best_worst(key: str) -> str:
    return with_scored(f""", seg AS ({segment_sql(key)}),
b AS (SELECT * FROM seg ORDER BY "defaultRate" ASC, "totalDisbursed" DESC LIMIT 1),
w AS (SELECT * FROM seg ORDER BY "defaultRate" DESC, "totalDisbursed" DESC LIMIT 1)
SELECT b.segment AS best_segment, b."defaultRate" AS best_default_rate, b."totalDisbursed" AS best_aum,
  w.segment AS worst_segment, w."defaultRate" AS worst_default_rate,
  w."avgDefaultProb" AS worst_avg_default_prob
FROM b, w""")


ORACLE["best_worst_geography"] = _best_worst("geography")
ORACLE["best_worst_product"] = _best_worst("product_type")

ORACLE["active_or_all"] = with_scored("""
SELECT * FROM scored
WHERE loan_status = 'Active' OR NOT EXISTS (SELECT 1 FROM scored WHERE loan_status = 'Active')""")

ORACLE["grade_lookup_join"] = with_loans(f"""
SELECT l.loan_id, l.credit_quality, coalesce(g.pd, {K.RULE_UNKNOWN_GRADE_PD}e0) AS grade_pd
FROM loans l LEFT JOIN (VALUES {", ".join(f"({q(k)}, {v}e0)" for k, v in K.RULE_GRADE_PD.items())}) AS g(grade, pd)
  ON g.grade = l.credit_quality""")

ORACLE["auc_rule"] = with_loans(f""", s AS (
  SELECT {R(RULE_PD_RAW, 4)} AS s, default_indicator AS y FROM loans),
per AS (SELECT s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM s GROUP BY s),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS neg_below FROM per),
t AS (SELECT sum(pos * (2 * neg_below + neg)) AS num2, sum(pos) AS p, sum(neg) AS n FROM cum)
SELECT CASE WHEN p > 0 AND n > 0 THEN {R('CAST(num2 AS DOUBLE) / (2e0 * CAST(p AS DOUBLE) * CAST(n AS DOUBLE))', 4)}
  ELSE 0e0 END AS auc FROM t""")

ORACLE["distinct_grades"] = with_loans(
    "SELECT DISTINCT credit_quality AS grade FROM loans WHERE credit_quality IS NOT NULL")
ORACLE["class_counts"] = with_loans(
    "SELECT count(DISTINCT credit_quality) AS n_grades, count(DISTINCT default_indicator) AS n_label_classes "
    "FROM loans")
ORACLE["load_summary"] = with_loans(f"""
SELECT * FROM (SELECT count(*) AS total_loans, {R(imean('default_indicator') + ' * 1e2', 1)} AS default_rate,
  {itrunc(imean('credit_score'))} AS avg_credit_score, {big('sum(loan_size)')} AS total_aum,
  array_to_string(list_sort(list(DISTINCT credit_quality)), ',') AS grades_found
FROM loans) WHERE total_loans > 0""")
ORACLE["status_counts"] = with_loans(
    "SELECT loan_status, count(*) AS \"count\", CAST(sum(default_indicator) AS BIGINT) AS defaults "
    "FROM loans GROUP BY loan_status")

# ---------------------------------------------------------------------------
# Watch-lists
# ---------------------------------------------------------------------------


def _watch(limit_sql: str) -> str:
    return with_scored(f""", act AS (
  SELECT * FROM scored WHERE loan_status = 'Active'
    OR NOT EXISTS (SELECT 1 FROM scored WHERE loan_status = 'Active')),
top AS ({limit_sql})
SELECT loan_id, {R('early_warning_score', 4)} AS early_warning_score, credit_quality, product_type, geography,
  {R('cashflow_consistency', 4)} AS cashflow_consistency, {R('dti_ratio', 4)} AS dti_ratio,
  spending_shock <> 0 AS spending_shock, {R('default_prob', 4)} AS default_prob, cluster
FROM top""")


_EW_ORDER = "ORDER BY early_warning_score DESC, loan_id ASC"
ORACLE["early_warning_top50"] = _watch(f"SELECT * FROM act {_EW_ORDER} LIMIT {K.WATCHLIST_SIZE}")
ORACLE["early_warning_top8"] = _watch(f"SELECT * FROM act {_EW_ORDER} LIMIT {K.CARD_LIST_SIZE}")
ORACLE["early_warning_by_grade"] = _watch(
    f"SELECT * FROM act WHERE credit_quality = 'CCC' {_EW_ORDER} LIMIT {K.WATCHLIST_SIZE}")

# ---------------------------------------------------------------------------
# Money text and benchmark status
# ---------------------------------------------------------------------------


def inr_sql(x: str) -> str:
    v = f"round_even(CAST({x} AS DOUBLE), 0)"
    u = f"CAST(abs({v}) AS BIGINT)"

    def tenths(div: int) -> str:
        t = f"(({u} + {div // 20}) // {div // 10})"
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR)"
    k = f"CAST(({u} + 500) // 1000 AS VARCHAR)"
    return (f"('₹' || CASE WHEN {v} >= 1e7 THEN {tenths(10_000_000)} || 'Cr' "
            f"WHEN {v} >= 1e5 THEN {tenths(100_000)} || 'L' "
            f"WHEN {v} < 0e0 THEN '-' || {k} || 'K' ELSE {k} || 'K' END)")


ORACLE["inr_format"] = with_scored(f""", seg AS (
  SELECT 'products' AS dimension, * FROM ({segment_sql('product_type')})
  UNION ALL SELECT 'grades' AS dimension, * FROM ({segment_sql('credit_quality')}))
SELECT dimension, segment, "totalDisbursed", {inr_sql('"totalDisbursed"')} AS aum_text,
  {inr_sql('CAST("count" AS DOUBLE) * "avgPricing" * 1000e0')} AS revenue_text
FROM seg""")

ORACLE["benchmark_status"] = with_scored(f""", m AS (
  SELECT {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate", count(*) AS n FROM scored)
SELECT "defaultRate", {K.INDUSTRY_DEFAULT_BENCHMARK}e0 AS benchmark,
  CASE WHEN "defaultRate" > {K.INDUSTRY_DEFAULT_BENCHMARK}e0 THEN 'ABOVE' ELSE 'BELOW' END AS status
FROM m WHERE n > 0""")

# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------
from .oracle import CSV_CTE, umean, usum, with_normalized, with_upload  # noqa: E402

_NORM_STEPS = {
    "normalize_headers": ("nm_headers", "*"),
    "normalize_grade": ("nm_grade", "loan_id, credit_quality"),
    "grade_from_score": ("nm_score", "loan_id, credit_quality"),
    "normalize_employment": ("nm_emp", "loan_id, employment_type"),
    "normalize_product": ("nm_prod", "loan_id, product_type"),
    "normalize_geography": ("nm_geo", "loan_id, geography"),
    "normalize_channel": ("nm_chan", "loan_id, acquisition_channel"),
    "parse_default_flag": ("nm_flag", "loan_id, default_indicator"),
    "parse_delinquency": ("nm_delinq", "loan_id, delinquency_status"),
    "loan_status": ("nm_status", "loan_id, loan_status"),
    "coerce_numeric": ("nm_num", "loan_id, " + ", ".join(K.NUMERIC_DEFAULTS)),
    "fill_strings": ("nm_str", "loan_id, " + ", ".join(K.STRING_DEFAULTS)),
}
for _step, (_cte, _cols) in _NORM_STEPS.items():
    ORACLE[_step] = with_normalized(f"SELECT {_cols} FROM {_cte}")

_CANON = ("loan_id, geography, employment_type, credit_score, income_proxy, credit_quality, product_type, loan_size, "
          "tenure_months, pricing_rate, ltv_ratio, dti_ratio, delinquency_status, loan_status, cashflow_consistency, "
          "balance_volatility, spending_shock, acquisition_channel, origination_month, cohort, default_indicator, "
          "value_proxy")
ORACLE["normalize_loans"] = with_normalized(f"SELECT {_CANON} FROM nm_final")
ORACLE["csv_upload_lines"] = "WITH " + CSV_CTE + f"SELECT {_CANON}, 'first ' || loan_id AS note FROM nm_final"
ORACLE["csv_roundtrip"] = "WITH " + CSV_CTE + f"SELECT {_CANON}, 'first' || chr(10) || loan_id AS note FROM nm_final"
ORACLE["assign_loan_ids"] = with_normalized(
    "SELECT * RENAME (loan_id AS ref), printf('LN-%06d', row_number() OVER (ORDER BY loan_id)) AS loan_id FROM raw_loans")
ORACLE["cohort_bucket"] = with_loans(
    "SELECT loan_id, origination_month, "
    "'C' || CAST(CAST(floor(trunc(origination_month) / 6e0) + 1 AS BIGINT) AS VARCHAR) AS cohort FROM loans")
ORACLE["value_proxy"] = with_loans(
    f"SELECT loan_id, {R('loan_size * pricing_rate / 100 * (CASE WHEN default_indicator = 1 THEN -0.4e0 ELSE 0.8e0 END)', 2)}"
    " AS value_proxy FROM loans")
ORACLE["derived_ratios"] = with_loans(
    f"SELECT loan_id, {CLIP(R('CAST(loan_size AS DOUBLE) / (income_proxy * 12 * 0.4e0)', 3), '0e0', '3e0')} AS ltv_ratio, "
    f"{CLIP(R('CAST(loan_size AS DOUBLE) / tenure_months / income_proxy', 4), '0e0', '0.8e0')} AS dti_ratio FROM loans")

# ---------------------------------------------------------------------------
# Policy text
# ---------------------------------------------------------------------------
_P = K  # titles and advice: the oracle's own copy


def _fx(x: str, d: int) -> str:
    return f"printf('%.{d}f', {R(x, d)})"


def _sc(x: str, scale: str, d: int) -> str:
    return _fx(f"CAST({x} AS DOUBLE) / {scale}", d)


def _rp(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def _gr(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_POLICY_FACTS = f""",
m AS ({ORACLE['portfolio_metrics'][len('WITH ' + __import__('loanframe.plans.oracle', fromlist=['SCORED_CTE']).SCORED_CTE):]}),
{_GRADE_AGG}, {_RISK_DIST},
g AS (SELECT
    coalesce(max(CASE WHEN grade = 'CCC' THEN "count" END), 0) AS ccc_count,
    coalesce(max(CASE WHEN grade = 'CCC' THEN "avgDefaultProb" END), 0e0) AS ccc_pd,
    coalesce(max(CASE WHEN grade = 'BB' THEN "count" END), 0) AS bb_count,
    coalesce(max(CASE WHEN grade = 'BB' THEN "avgDefaultProb" END), 0e0) AS bb_pd,
    coalesce(max(CASE WHEN grade = 'B' THEN "count" END), 0) AS b_count,
    coalesce(max(CASE WHEN grade = 'B' THEN "avgDefaultProb" END), 0e0) AS b_pd
  FROM rd),
e AS (SELECT count(*) FILTER (WHERE early_warning_score > 60) AS high,
  count(*) FILTER (WHERE early_warning_score >= 40 AND early_warning_score <= 60) AS medium,
  count(*) FILTER (WHERE early_warning_score < 40) AS low,
  CAST(coalesce(sum(spending_shock), 0) AS BIGINT) AS shocks FROM scored),
sg AS ({segment_sql('geography')}),
bg AS (SELECT * FROM sg ORDER BY "defaultRate" ASC, "totalDisbursed" DESC LIMIT 1),
wg AS (SELECT * FROM sg ORDER BY "defaultRate" DESC, "totalDisbursed" DESC LIMIT 1),
sp AS ({segment_sql('product_type')}),
bp AS (SELECT * FROM sp ORDER BY "defaultRate" ASC, "totalDisbursed" DESC LIMIT 1),
wp AS (SELECT * FROM sp ORDER BY "defaultRate" DESC, "totalDisbursed" DESC LIMIT 1),
f AS (SELECT m.*, g.*, e.high, e.medium, e.low, e.shocks,
    bg.segment AS bg_seg, bg."defaultRate" AS bg_rate, bg."totalDisbursed" AS bg_aum,
    wg.segment AS wg_seg, wg."defaultRate" AS wg_rate, wg."avgDefaultProb" AS wg_pd,
    bp.segment AS bp_seg, bp."defaultRate" AS bp_rate, bp."avgPricing" AS bp_price,
    wp.segment AS wp_seg, wp."defaultRate" AS wp_rate
  FROM m, g, e, bg, wg, bp, wp)
"""


def _policy_rows(items) -> str:
    parts = [f"SELECT {i + 1} AS rank, {q(t)} AS title, {typ} AS type, {body} AS body FROM f"
             for i, (t, typ, body) in enumerate(items)]
    return with_scored(_POLICY_FACTS + "\n" + "\nUNION ALL\n".join(parts))


_B = K.INDUSTRY_DEFAULT_BENCHMARK
ORACLE["policy_recommendations"] = _policy_rows([
    (_P.TITLES[0], "'info'",
     f"""'Portfolio of ' || {_gr('"totalLoans"')} || ' loans with AUM of ₹' || {_sc('"totalDisbursed"', '1e7', 2)}
     || 'Cr. Actual default rate: ' || {_fx('"defaultRate"', 1)} || '% — '
     || CASE WHEN "defaultRate" > {_B}e0 THEN 'ABOVE' ELSE 'BELOW' END
     || ' the {_B}% industry benchmark. ML-predicted average default probability: ' || {_fx('"avgDefaultProb"', 2)}
     || '%. Average Credit Score: ' || {_s('"avgCreditScore"')} || '. Avg Early Warning Score: '
     || {_rp('"avgEWScore"')} || '/100.'"""),
    (_P.TITLES[1],
     """CASE WHEN "avgDefaultProb" > 10 THEN 'danger' WHEN "avgDefaultProb" > 5 THEN 'warning' ELSE 'info' END""",
     f"""'Random Forest + Gradient Boosting ensemble trained on ' || {_gr('"totalLoans"')}
     || ' loans. CCC-grade segment: ' || {_s('ccc_count')} || ' loans, ML-estimated default probability: '
     || {_fx('ccc_pd', 1)} || '%. BB-grade: ' || {_s('bb_count')} || ' loans at ' || {_fx('bb_pd', 1)}
     || '% ML prob. B-grade: ' || {_s('b_count')} || ' loans at ' || {_fx('b_pd', 1)} || '% ML prob. '
     || CASE WHEN ccc_count > 0 THEN {q(_P.CCC_ACTION)} ELSE '' END"""),
    (_P.TITLES[2], "'warning'",
     f"""'Isolation Forest anomaly detection: ' || {_s('high')} || ' loans flagged as high-risk (score > 60). '
     || {_s('medium')} || ' loans in medium-risk zone (40–60). ' || {_s('shocks')}
     || ' loans show spending shock signals. Risk distribution — High: ' || {_s('high')} || ' | Medium: '
     || {_s('medium')} || ' | Low: ' || {_s('low')} || '. ' || {q(_P.EW_ACTION)}"""),
    (_P.TITLES[3], "CASE WHEN bg_rate < 5 THEN 'success' ELSE 'info' END",
     f"""'Best performing geography: ' || bg_seg || ' (default rate: ' || {_fx('bg_rate', 1)} || '%, AUM: ₹'
     || {_sc('bg_aum', '1e5', 1)} || 'L). Highest risk geography: ' || wg_seg || ' (default rate: '
     || {_fx('wg_rate', 1)} || '%, ML prob: ' || {_fx('wg_pd', 1)} || '%). Action: Expand originations in '
     || bg_seg || '; tighten criteria in ' || wg_seg || '.'"""),
    (_P.TITLES[4], "'success'",
     f"""'Best performing product: ' || bp_seg || ' (default rate: ' || {_fx('bp_rate', 1)} || '%, avg pricing: '
     || {_fx('bp_price', 1)} || '%). Highest-risk product: ' || wp_seg || ' (default rate: ' || {_fx('wp_rate', 1)}
     || '%). Action: Increase allocation to ' || bp_seg || '. Review pricing model for ' || wp_seg || '.'"""),
    (_P.TITLES[5], "'info'",
     f"""'Current avg pricing: ' || {_fx('"avgPricing"', 2)} || '%. At-risk AUM: ₹' || {_sc('"atRiskAUM"', '1e7', 2)}
     || 'Cr. ' || {q(_P.PRICING_FLOOR)} || ' Total value proxy: ₹' || {_sc('"totalValueProxy"', '1e7', 2)}
     || 'Cr. ' || {q(_P.PRICING_ACTION)}"""),
])

ORACLE["policy_memo"] = _policy_rows([
    (_P.MEMO_TITLES[0], "'info'",
     f"""'Portfolio of ' || {_gr('"totalLoans"')} || ' loans with AUM of ₹' || {_sc('"totalDisbursed"', '1e7', 1)}
     || 'Cr. ML-predicted avg default probability: ' || {_fx('"avgDefaultProb"', 1)} || '%. Actual default rate '
     || {_rp('"defaultRate"')} || '% is ' || CASE WHEN "defaultRate" > 8 THEN 'above' ELSE 'below' END
     || ' the 8% industry benchmark. Average Early Warning Score: ' || {_rp('"avgEWScore"')} || '/100.'"""),
    (_P.MEMO_TITLES[1], """CASE WHEN "avgDefaultProb" > 10 THEN 'danger' ELSE 'info' END""",
     f"""'Random Forest + Gradient Boosting ensemble trained on ' || {_gr('"totalLoans"')}
     || ' loans. CCC-grade accounts (' || {_s('ccc_count')} || ' loans) carry ML-estimated default probability of '
     || {_fx('ccc_pd', 1)} || '%. ' || {q(_P.MEMO_CCC_ADVICE)}"""),
    (_P.MEMO_TITLES[2], "'warning'",
     f"""'Isolation Forest anomaly detection flagged ' || {_s('high')} || ' loans as high-risk (score > 60). '
     || {_s('shocks')} || ' loans show spending shock signals. ' || {q(_P.MEMO_EW_ADVICE)}"""),
    (_P.MEMO_TITLES[3], "'success'", q(_P.MEMO_KMEANS)),
    (_P.MEMO_TITLES[4], "'info'", f"""'Current avg pricing: ' || {_rp('"avgPricing"')} || '%. ' || {q(_P.MEMO_PRICING)}"""),
    (_P.MEMO_TITLES[5], "'info'",
     f"""'At-risk AUM: ₹' || {_sc('"atRiskAUM"', '1e7', 1)} || 'Cr. ' || {q(_P.MEMO_DIVERSIFY)}"""),
])

ORACLE["segment_summaries"] = with_scored(f""", {_GRADE_AGG}, {_RISK_DIST},
sg AS ({segment_sql('geography')}), sp AS ({segment_sql('product_type')})
SELECT 'grade' AS dimension, grade AS segment,
  grade || ': ' || {_s('"count"')} || ' loans, AUM ₹' || {_sc('aum', '1e5', 1)} || 'L, actual default '
  || {_fx('"defaultRate"', 1)} || '%, ML prob ' || {_fx('"avgDefaultProb"', 1)} || '%' AS line
FROM rd WHERE "count" > 0
UNION ALL
SELECT 'geography', segment, segment || ': ' || {_s('"count"')} || ' loans, default ' || {_fx('"defaultRate"', 1)}
  || '%, ML prob ' || {_fx('"avgDefaultProb"', 1)} || '%' FROM sg
UNION ALL
SELECT 'product', segment, segment || ': ' || {_s('"count"')} || ' loans, default ' || {_fx('"defaultRate"', 1)}
  || '%, pricing ' || {_fx('"avgPricing"', 1)} || '%' FROM sp""")

ORACLE["stream_scored_loans"] = ORACLE["scored_loans"]

# ---------------------------------------------------------------------------
# Feature encoding
# ---------------------------------------------------------------------------
ORACLE["encode_categories"] = with_loans(", " + ", ".join(
    f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM loans WHERE {c} IS NOT NULL))"
    for c in K.CAT_COLS) + "\nSELECT l.loan_id, " + ", ".join(
    f"coalesce(d_{c}.code, 0) AS cat_{c}" for c in K.CAT_COLS) + " FROM loans l " + " ".join(
    f"LEFT JOIN d_{c} ON d_{c}.v = CAST(l.{c} AS VARCHAR)" for c in K.CAT_COLS))


def _z(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    sd = f"stddev_pop({x}) OVER ()"
    return R(f"({x} - avg({x}) OVER ()) / CASE WHEN {sd} = 0 OR {sd} IS NULL THEN 1e0 ELSE {sd} END", 4)


_CODES = ORACLE["encode_categories"]
ORACLE["encode_categories_joined"] = _CODES
ORACLE["dense_codes"] = with_loans(
    "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT CAST(loan_size AS VARCHAR) AS value FROM loans)")
ORACLE["standardize_features"] = (
    f"SELECT loan_id, {', '.join(f'{_z(c)} AS z_{c}' for c in [f'cat_{c}' for c in K.CAT_COLS] + K.NUM_COLS)} "
    f"FROM (SELECT l.*, {', '.join(f'e.cat_{c}' for c in K.CAT_COLS)} FROM ({with_loans('SELECT * FROM loans')}) l "
    f"JOIN ({_CODES}) e USING (loan_id))")
ORACLE["hyperparameters"] = with_loans("""
SELECT *, greatest(10, least(120, n * 5)) AS rf_trees, least(8, greatest(2, n // 2)) AS rf_depth, greatest(1, least(3, n // 5)) AS rf_min_leaf,
  greatest(10, least(80, n * 3)) AS gb_trees, least(4, greatest(2, n // 3)) AS gb_depth, greatest(1, least(4, n)) AS kmeans_k,
  greatest(0.01e0, least(1e0, CAST(n AS DOUBLE) / 100)) AS lr_c
FROM (SELECT geography, product_type, employment_type, credit_quality, count(*) AS n FROM loans GROUP BY ALL)""")
ORACLE["isolation_rows"] = with_loans("""
SELECT 'book' AS part, loan_id FROM loans WHERE loan_status = 'Active'
UNION ALL SELECT 'few', loan_id FROM loans WHERE loan_status <> 'Active'""")
ORACLE["auc_rule_unrounded"] = with_loans(f""", s AS (SELECT {RULE_PD_RAW} AS s, default_indicator AS y FROM loans),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rk FROM s),
t AS (SELECT sum(rk) FILTER (y = 1) AS w, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM r)
SELECT CASE WHEN p > 0 AND n > 0 THEN {R('(w - p * (p + 1) / 2) / (p * n)', 4)} ELSE 0e0 END AS auc FROM t""")
ORACLE["score_ranks"] = with_loans(f""", s AS (SELECT {RULE_PD_RAW} AS s FROM loans)
SELECT s AS rule_pd, count(*) AS n, avg(rk) AS rank FROM (SELECT s, row_number() OVER (ORDER BY s) AS rk FROM s) GROUP BY s""")
ORACLE["score_quantiles"] = with_loans(f""", s AS (SELECT {RULE_PD_RAW} AS s FROM loans)
SELECT share, {R('value', 9)} AS value FROM (
  SELECT unnest([0.05e0, 0.12e0, 0.5e0, 0.993e0]) AS share, unnest(quantile_cont(s, [0.05, 0.12, 0.5, 0.993])) AS value FROM s)""")
ORACLE["scatter_bubbles"] = f"""SELECT *, sqrt(CAST(r AS DOUBLE)) * 1.2e0 AS radius FROM ({ORACLE["scatter_grade"]})"""
ORACLE["segments_present"] = with_scored(f"""
SELECT *, 'geography' AS dimension FROM ({segment_sql('geography')})
UNION ALL SELECT *, 'product_type' FROM ({segment_sql('product_type')})""")


def _short(x: str) -> str:
    """Chart axis text; the tie rule compares 8 x + 2 x - n - 1/2, which is exact."""
    def tenths(y: str) -> str:
        n = f"CAST(floor({y} * 10e0) AS BIGINT)"
        t = f"({n} + CASE WHEN ({y} * 8e0 - (CAST({n} AS DOUBLE) + 0.5e0)) + {y} * 2e0 >= 0 THEN 1 ELSE 0 END)"
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR)"
    v = f"CAST({x} AS DOUBLE)"
    a = f"abs({v})"
    k = f"CAST(floor({a} / 1e3) AS BIGINT)"
    whole = f"CAST({k} + CASE WHEN {a} / 1e3 - (CAST({k} AS DOUBLE) + 0.5e0) >= 0 THEN 1 ELSE 0 END AS VARCHAR)"
    return (f"(CASE WHEN {v} IS NULL THEN '0' ELSE CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN {a} >= 1e7 THEN "
            f"{tenths(f'({a} / 1e7)')} || 'Cr' WHEN {a} >= 1e5 THEN {tenths(f'({a} / 1e5)')} || 'L' "
            f"WHEN {a} >= 1e3 THEN {whole} || 'K' ELSE {tenths(a)} END END)")


ORACLE["short_number"] = with_scored(f""", seg AS (
  SELECT 'products' AS dimension, * FROM ({segment_sql('product_type')})
  UNION ALL SELECT 'grades' AS dimension, * FROM ({segment_sql('credit_quality')}))
SELECT dimension, segment, {', '.join(f'{_short(chr(34) + c + chr(34))} AS "{c}_text"' for c in ("totalDisbursed", "count", "avgPricing", "defaultRate"))},
  {_short('-"avgScore" * 1234.5e0')} AS negative_text, '0' AS missing_text FROM seg""")

# ---------------------------------------------------------------------------
# Uploads with fractions: sums are taken over unrounded values and truncated once
# ---------------------------------------------------------------------------
ORACLE["portfolio_metrics_upload"] = with_upload(f"""
SELECT count(*) AS "totalLoans", CAST(trunc({usum('loan_size')}) AS BIGINT) AS "totalDisbursed",
  {itrunc(umean('loan_size'))} AS "avgTicketSize",
  {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
  {R("CAST(sum(CASE WHEN delinquency_status <> 'Current' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 1e2", 1)}
    AS "delinquencyRate",
  {itrunc(umean('credit_score'))} AS "avgCreditScore", {R(umean('pricing_rate'), 2)} AS "avgPricing",
  CAST(trunc({usum('value_proxy')}) AS BIGINT) AS "totalValueProxy",
  CAST(trunc({usum("CASE WHEN loan_status <> 'Active' THEN loan_size END")}) AS BIGINT) AS "atRiskAUM",
  {R(umean('default_prob') + ' * 1e2', 2)} AS "avgDefaultProb", {R(umean('early_warning_score'), 1)} AS "avgEWScore"
FROM scored""")
ORACLE["segments_upload"] = with_upload(f"""
SELECT geography AS segment, count(loan_id) AS "count", CAST(trunc({usum('loan_size')}) AS BIGINT) AS "totalDisbursed",
  {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate", {itrunc(umean('credit_score'))} AS "avgScore",
  {R(umean('pricing_rate'), 2)} AS "avgPricing", {R(umean('default_prob') + ' * 1e2', 2)} AS "avgDefaultProb"
FROM scored WHERE geography IS NOT NULL GROUP BY geography""")

# Badge bands
ORACLE["cohort_bands"] = f"""SELECT *,
  CASE WHEN "defaultRate" > 12 THEN 'danger' WHEN "defaultRate" > 7 THEN 'warning' ELSE 'success' END AS "cohortBand",
  CASE WHEN "delinqRate" > 15 THEN 'warning' ELSE 'neutral' END AS "delinqBand"
FROM ({ORACLE["cohort_analysis"]})"""
ORACLE["watch_bands"] = f"""SELECT *,
  CASE WHEN early_warning_score > 60 THEN 'danger' WHEN early_warning_score > 40 THEN 'warning' ELSE 'success' END AS "ewBand"
FROM ({ORACLE["early_warning_top50"]})"""

# ---------------------------------------------------------------------------
# A forest of two fixed trees: path lengths are depth + c(rows)
# ---------------------------------------------------------------------------


def _c(m: int) -> str:
    return "0e0" if m < 2 else "1e0" if m == 2 else f"(2e0 * (ln({m - 1}e0) + 0.5772156649015329e0) - 2e0 * {m - 1}e0 / {m}e0)"


ORACLE["anomaly_scores_fixed"] = with_loans(f""", paths AS (
  SELECT *, CASE WHEN credit_score <= 640 THEN CASE WHEN dti_ratio <= 0.35e0 THEN 2e0 + {_c(66)} ELSE 2e0 + {_c(4)} END
                 ELSE 1e0 + {_c(186)} END AS t0,
    CASE WHEN balance_volatility <= 0.8e0 THEN 1e0 + {_c(254)} ELSE 2e0 END AS t1 FROM loans),
s AS (SELECT *, -pow(2e0, -((t0 + t1) / 2e0) / {_c(256)}) AS s FROM paths)
SELECT loan_id, {R('s', 6)} AS score, {R('s + 0.5e0', 6)} AS decision,
  {R(CLIP(CLIP(EW_BASE, '0e0', '100e0') + ' * 0.6e0 + ' + RULE_PD + ' * 100e0 * 0.4e0 + ' + CLIP('-(s + 0.5e0)', '0e0', '1e0') + ' * 10e0', '0e0', '100e0'), 1)} AS early_warning_score
FROM s""")

# Model scoring by value
from .oracle_models import MODELS  # noqa: E402

ORACLE.update(MODELS)
