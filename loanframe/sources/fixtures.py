"""Loan tables derived from the driver's TPC-H-style tables.

``loans``      one canonical loan per order (orders JOIN customer), with a
               deterministic pseudo-random chain per row.
``raw_loans``  the same loans rendered as a messy all-string upload with
               template headers, for the normaliser.

Both are plain projections over one equi-join, so they scale with the
``orders`` table: the join key is the customer key; Catalyst/AQE pick a
broadcast when the (pruned) customer side is small and a sort-merge join
with skew splitting otherwise (a customer holding a third of all orders is
split across tasks by AQE's skew-join handling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clip, lookup, rnd, score_to_grade
from .tables import read_table

# Fixed values of the fixture: pseudo-random chain and per-grade thresholds.
CHAIN_MUL_ORDER, CHAIN_MUL_CUST, CHAIN_MOD0 = 7919, 104729, 1000003
CHAIN_MUL, CHAIN_MOD = 48271, 2147483647
FIXTURE_DEFAULT_PER_MILLE = {"AAA": 10, "AA": 20, "A": 40, "BBB": 70, "BB": 120, "B": 200, "CCC": 350}
SEGMENT_TO_EMPLOYMENT = {"AUTOMOBILE": "Salaried", "BUILDING": "Self-Employed",
                         "FURNITURE": "Gig Worker", "HOUSEHOLD": "Small Business"}
PRIORITY_TO_PRODUCT = {"1": "Personal Loan", "2": "SME Working Capital", "3": "BNPL",
                       "4": "Unsecured Consumer"}


def _pick(index: Column, values: list) -> Column:
    """values[index] for a small literal list (index already in range)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _loan_id(n: Column) -> Column:
    """The text of LN-%06d. A formatter is dear per row, so it is left to numbers below 0 (and to none)."""
    digits = n.cast("string")
    return F.when(n > 999_999, F.concat(F.lit("LN-"), digits)).when(n >= 0, F.concat(F.lit("LN-"), F.lpad(digits, 6, "0"))).otherwise(
        F.format_string("LN-%06d", n))


def _chain(k: Column, ck: Column, steps: int) -> list[Column]:
    h = [(k * CHAIN_MUL_ORDER + ck * CHAIN_MUL_CUST) % CHAIN_MOD0]
    for _ in range(steps):
        h.append((h[-1] * CHAIN_MUL) % CHAIN_MOD)
    return h


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical 22-column loans table (see FIXTURES.md, section B)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")

    h = _chain(F.col("o_orderkey"), F.col("o_custkey"), 6)
    seg = F.col("c_mktsegment")
    emp = None
    for s, e in SEGMENT_TO_EMPLOYMENT.items():
        emp = F.when(seg == s, e) if emp is None else emp.when(seg == s, e)
    pri = F.substring(F.col("o_orderpriority"), 1, 1)
    prod = None
    for p, name in PRIORITY_TO_PRODUCT.items():
        prod = F.when(pri == p, name) if prod is None else prod.when(pri == p, name)

    base = j.select(
        _loan_id(F.col("o_orderkey") + 1).alias("loan_id"),
        _pick(F.col("c_nationkey") % 4, K.GEOGRAPHIES).alias("geography"),
        emp.otherwise("Informal").alias("employment_type"),
        (F.lit(540) + h[1] % 361).cast("long").alias("credit_score"),
        F.floor(F.lit(20000) + (F.col("c_acctbal") + 1000) * 10).cast("long").alias("income_proxy"),
        prod.otherwise("Micro Loan").alias("product_type"),
        F.floor(F.col("o_totalprice")).cast("long").alias("loan_size"),
        _pick(h[2] % 5, K.TENURES).cast("int").alias("tenure_months"),
        h[2].alias("_h2"), h[3].alias("_h3"), h[4].alias("_h4"), h[5].alias("_h5"), h[6].alias("_h6"),
    ).withColumn("credit_quality", score_to_grade("credit_score"))

    # Stage the per-row flags as named columns so later expressions refer to
    # them instead of re-inlining the grade lookup (keeps generated code small).
    g = F.col("credit_quality")
    flags = base.withColumns({
        "_pdm": lookup(FIXTURE_DEFAULT_PER_MILLE, g),
        "_rate": lookup(K.GRADE_BASE_RATE, g),
    }).withColumn("_def", (F.col("_h3") % 1000) < F.col("_pdm"))
    flags = flags.withColumn("_del", (~F.col("_def")) & ((F.col("_h4") % 1000) * 2 < F.col("_pdm") * 5))
    size = F.col("loan_size").cast("double")
    is_def, is_del = F.col("_def"), F.col("_del")
    out = flags.select(
        "loan_id", "geography", "employment_type", "credit_score", "income_proxy", "credit_quality",
        "product_type", "loan_size", "tenure_months",
        ((F.col("_rate") * 100 + F.col("_h6") % 201 - 100).cast("double") / 100).alias("pricing_rate"),
        clip(size / (F.col("income_proxy") * 12 * F.lit(0.4)), 0.0, 3.0).alias("ltv_ratio"),
        clip(size / F.col("tenure_months") / F.col("income_proxy"), 0.0, 0.8).alias("dti_ratio"),
        F.when(is_def, "Default").when(is_del, "DPD30+").otherwise("Current").alias("delinquency_status"),
        F.when(is_def, "Default").when(is_del, "At-Risk").otherwise("Active").alias("loan_status"),
        ((F.lit(10) + F.col("_h2") % 81).cast("double") / 100).alias("cashflow_consistency"),
        ((F.lit(5) + F.col("_h4") % 81).cast("double") / 100).alias("balance_volatility"),
        ((F.col("_h6") % 100) < 15).cast("int").alias("spending_shock"),
        _pick(F.col("_h5") % 5, K.CHANNELS).alias("acquisition_channel"),
        (F.col("_h5") % 24).cast("int").alias("origination_month"),
        is_def.cast("int").alias("default_indicator"),
    )
    out = out.withColumn(
        "cohort", F.concat(F.lit("C"), (F.floor(F.col("origination_month") / F.lit(6.0)) + 1).cast("int").cast("string")))
    out = out.withColumn("value_proxy", rnd(
        F.col("loan_size") * F.col("pricing_rate") / 100
        * F.when(F.col("default_indicator") == 1, F.lit(-0.4)).otherwise(F.lit(0.8)), 2))
    return out.select(*LOAN_COLUMNS)


LOAN_COLUMNS = ["loan_id", "geography", "employment_type", "credit_score", "income_proxy", "credit_quality",
                "product_type", "loan_size", "tenure_months", "pricing_rate", "ltv_ratio", "dti_ratio",
                "delinquency_status", "loan_status", "cashflow_consistency", "balance_volatility",
                "spending_shock", "acquisition_channel", "origination_month", "cohort",
                "default_indicator", "value_proxy"]

# Template headers of an upload, in file order.
RAW_COLUMNS = ["loan_id", "loan_amount", "cibil_score", "risk_grade", "region", "employment", "product",
               "interest_rate", "is_default", "dpd", "tenure", "channel", "income", "dti"]


def _cycle(n: Column, modulus: int, cases: dict, otherwise: Column) -> Column:
    """Replace the value by ``cases[n % modulus]`` (None -> NULL)."""
    r = n % modulus
    out = None
    for i, v in cases.items():
        val = F.lit(None).cast("string") if v is None else (v if isinstance(v, Column) else F.lit(v))
        out = F.when(r == i, val) if out is None else out.when(r == i, val)
    return out.otherwise(otherwise)


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy all-string upload derived from ``loans`` (FIXTURES.md, section C)."""
    b = loans(spark, sf_dir).withColumn("_n", F.substring(F.col("loan_id"), 4, 32).cast("long"))
    n = F.col("_n")
    s = lambda c: F.col(c).cast("string")
    g = F.col("credit_quality")
    d = F.col("default_indicator") == 1
    return b.select(
        "loan_id",
        s("loan_size").alias("loan_amount"),
        F.when(n % 29 == 0, F.lit(None).cast("string")).when(n % 31 == 0, "abc")
        .otherwise(s("credit_score")).alias("cibil_score"),
        _cycle(n, 11, {0: F.lower(g), 1: F.concat(F.lit(" "), g, F.lit(" ")), 2: "prime", 3: "Good",
                       4: "poor", 5: "unknown", 6: None, 7: "MEDIUM"}, g).alias("risk_grade"),
        _cycle(n, 7, {0: "urban", 1: " tier_2 ", 2: "SEMI URBAN", 3: "village", 4: None, 5: " Coastal "},
               F.col("geography")).alias("region"),
        _cycle(n, 8, {0: "self_employed", 1: " SALARY", 2: "freelancer", 3: "sme", 4: "daily wage", 5: None,
                      6: "Pensioner"}, F.col("employment_type")).alias("employment"),
        _cycle(n, 6, {0: "PL", 1: "buy now pay later", 2: "microloan", 3: None, 4: "Gold Loan "},
               F.col("product_type")).alias("product"),
        F.when(n % 37 == 0, "1,200").otherwise(F.col("pricing_rate").cast("decimal(9,2)").cast("string"))
        .alias("interest_rate"),
        _cycle(n, 9, {0: F.when(d, "YES").otherwise("no"), 1: F.when(d, " npa ").otherwise("N"),
                      2: F.when(d, "True").otherwise("false")},
               F.when(d, "1").otherwise("0")).alias("is_default"),
        _cycle(n, 10, {0: "0", 1: "45", 2: "Overdue", 3: None, 4: "CURRENT", 5: "DPD90", 6: "30+ days",
                       7: "closed"}, F.col("delinquency_status")).alias("dpd"),
        F.when(n % 41 == 0, F.lit(None).cast("string")).otherwise(s("tenure_months")).alias("tenure"),
        _cycle(n, 5, {0: "ONLINE", 1: "fintech ", 2: "bc", 3: None}, F.col("acquisition_channel")).alias("channel"),
        F.when(n % 43 == 0, "").otherwise(s("income_proxy")).alias("income"),
        F.col("dti_ratio").cast("decimal(9,4)").cast("string").alias("dti"),
    )
