"""Normaliser: golden template, aliases, parsing rules, defaults, ids."""

import pytest
from pyspark.sql import functions as F

from loanframe.operators import normalize as N
from loanframe.operators import scoring as S
from tests.template_rows import sample_template
from tests.conftest import rows

# Golden output for the five-row template (FIXTURES.md section A).
GOLDEN = {
    "LN-000001": ("Current", "Active", 17400.0, 0.0909, 24.3),
    "LN-000002": ("Current", "Active", 64000.0, 0.1450, 27.4),
    "LN-000003": ("Default", "Default", -2200.0, 1.0, 60.6),
    "LN-000004": ("Current", "Active", 8000.0, 0.0575, 22.8),
    "LN-000005": ("Default", "Default", -1560.0, 1.0, 65.2),
}


def strings(spark, header, data):
    return spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in header))


def test_template_golden(spark):
    norm = N.normalize_loans(sample_template(spark))
    scored = S.score_rules(norm)
    got = {r[0]: r[1:] for r in rows(scored, "loan_id", "delinquency_status", "loan_status", "value_proxy",
                                     "default_prob", "early_warning_score")}
    assert got == GOLDEN
    extras = rows(norm.where("loan_id = 'LN-000001'"), "ltv_ratio", "cashflow_consistency", "balance_volatility",
                  "spending_shock", "origination_month", "cohort")
    assert extras == [(0.5, 0.7, 0.3, 0.0, 0.0, "C1")]


def test_rule_pd_before_override(spark):
    scored = N.normalize_loans(sample_template(spark)).select("loan_id", S.rule_pd_raw().alias("p"))
    got = {r[0]: round(r[1], 4) for r in scored.collect()}
    assert got == {"LN-000001": 0.0909, "LN-000002": 0.1450, "LN-000003": 0.3017, "LN-000004": 0.0575,
                   "LN-000005": 0.5152}


def test_header_canonicalisation_and_collision(spark):
    df = strings(spark, [" Loan-Amount ", "Principal", "CIBIL Score"], [(None, "500", "700"), ("100", "900", None)])
    out = N.canonical_headers(df)
    assert out.columns == ["loan_size", "credit_score"]
    assert rows(out) == [("500", "700"), ("100", None)]


@pytest.mark.parametrize("raw,expected", [
    ("prime", "AAA"), ("Good", "A"), (" fair ", "BBB"), ("MEDIUM", "BBB"), ("low", "AA"), ("poor", "CCC"),
    ("bad", "CCC"), ("high", "CCC"), ("investment", "AAA"), ("bbb", "BBB"), ("AA", "AA"), ("junk", None),
    (None, None)])
def test_grade_aliases(spark, raw, expected):
    df = strings(spark, ["credit_quality"], [(raw,)])
    assert rows(N.normalize_grade(df)) == [(expected,)]


def test_grade_from_score(spark):
    df = strings(spark, ["credit_quality", "credit_score"],
                 [(None, "805"), (None, "759.9"), (None, "abc"), (None, None), ("AA", "100"), (None, "5d")])
    assert [r[0] for r in rows(N.fill_grade_from_score(df), "credit_quality")] == ["AAA", "A", "CCC", "CCC",
                                                                                    "AA", "CCC"]
    assert rows(N.fill_grade_from_score(strings(spark, ["x"], [("1",)])), "credit_quality") == [("BBB",)]


@pytest.mark.parametrize("col,raw,expected", [
    ("employment_type", " SALARY", "Salaried"), ("employment_type", "daily wage", "Informal"),
    ("employment_type", "Pensioner", "Pensioner"), ("product_type", "PL", "Personal Loan"),
    ("product_type", "buy now pay later", "BNPL"), ("product_type", "Gold Loan ", "Gold Loan"),
    ("geography", " tier_2 ", "Tier-2"), ("geography", "village", "Rural"), ("geography", "Coastal", "Coastal"),
    ("acquisition_channel", "ONLINE", "Digital-Direct"), ("acquisition_channel", "bc", "NBFC-BC"),
])
def test_category_aliases(spark, col, raw, expected):
    df = strings(spark, [col], [(raw,)])
    out = N.normalize_employment(N.normalize_product(N.normalize_geography(N.normalize_channel(df))))
    assert rows(out, col) == [(expected,)]


@pytest.mark.parametrize("raw,flag", [("YES", 1), (" npa ", 1), ("True", 1), ("1", 1), ("1.0", 1), ("defaulted", 1),
                                      ("no", 0), ("N", 0), ("0", 0), (None, 0), ("2", 0)])
def test_default_flag(spark, raw, flag):
    df = strings(spark, ["default_indicator"], [(raw,)])
    assert rows(N.parse_default_flag(df)) == [(flag,)]


@pytest.mark.parametrize("flag,raw,status", [
    (1, "Current", "Default"), (0, "DPD30+", "DPD30+"), (0, "Overdue", "DPD30+"), (0, "30+ days", "DPD30+"),
    (0, "past due", "DPD30+"), (0, "CURRENT", "Current"), (0, "0", "Current"), (0, None, "Current"),
    (0, "45", "DPD30+"), (0, "-3", "Current"), (0, "DPD90", "Current"), (0, "closed", "Current"),
    (0, "5d", "Current")])
def test_delinquency_rules(spark, flag, raw, status):
    df = spark.createDataFrame([(flag, raw)], "default_indicator int, delinquency_status string")
    out = N.derive_loan_status(N.parse_delinquency(df))
    expected_status = {"Default": "Default", "DPD30+": "At-Risk", "Current": "Active"}[status]
    assert rows(out) == [(flag, status, expected_status)]


def test_absent_columns_get_defaults(spark):
    out = N.normalize_loans(strings(spark, ["loan amount"], [("5000",), ("x",)]))
    r = sorted(out.collect(), key=lambda x: x["loan_id"])
    assert [x["loan_id"] for x in r] == ["LN-000001", "LN-000002"]
    assert [x["loan_size"] for x in r] == [5000.0, 100000.0]
    assert r[0]["credit_quality"] == "BBB" and r[0]["geography"] == "Metro" and r[0]["default_indicator"] == 0
    assert r[0]["delinquency_status"] == "Current" and r[0]["cohort"] == "C1"
    assert r[0]["value_proxy"] == 600.0  # 5000 * 15 / 100 * 0.8


def test_numeric_coercion(spark):
    df = strings(spark, ["tenure", "shock", "month"], [("1,200", "true", "13.7"), ("", "false", None),
                                                     (" 24 ", "1", "-1")])
    out = N.cohort_bucket(N.coerce_numeric(N.canonical_headers(df)))
    assert rows(out, "tenure_months", "spending_shock", "origination_month", "cohort") == [
        (12.0, 1.0, 13.7, "C3"), (12.0, 0.0, 0.0, "C1"), (24.0, 1.0, -1.0, "C0")]


def test_loan_ids_follow_scan_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.col("id").cast("string").alias("amount"))
    out = N.assign_loan_ids(df)
    got = {int(r["amount"]): r["loan_id"] for r in out.collect()}
    assert got == {i: f"LN-{i + 1:06d}" for i in range(1000)}


def test_loan_ids_by_order_column(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "ref string").repartition(3)
    assert sorted(rows(N.assign_loan_ids(df, order_col="ref"), "ref", "loan_id")) == [
        ("a", "LN-000001"), ("b", "LN-000002"), ("c", "LN-000003")]


def test_derived_ratios_clip(spark):
    df = spark.createDataFrame([(1e9, 1000.0, 6.0), (100.0, 1e6, 36.0)],
                               "loan_size double, income_proxy double, tenure_months double")
    out = rows(N.derive_ratios(df), "ltv_ratio", "dti_ratio")
    assert out[0] == (3.0, 0.8) and out[1][0] == 0.0
