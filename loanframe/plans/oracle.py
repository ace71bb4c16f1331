"""Independent SQL statements of every checked query, for DuckDB.

These are written separately from the DataFrame operators (a second,
declarative implementation of the same semantics) so the two check each
other. Only the driver tables are assumed to exist as views; the ``loans``,
``raw_loans`` and ``scored`` inputs are rebuilt here as CTEs.

DuckDB notes: plain decimals such as 0.8 are DECIMAL literals, so doubles
are written 0.8e0; sum(BIGINT) is HUGEINT and is cast back; rounding uses
round_even on a scaled value (numpy's half-to-even rounding).
"""

from __future__ import annotations

from . import oracle_values as K


def R(expr: str, n: int) -> str:
    return f"(round_even(({expr}) * 1e{n}, 0) / 1e{n})"


def CLIP(expr: str, lo: str | None, hi: str | None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return out


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def case_index(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {v if isinstance(v, (int, float)) else q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def grade_of(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {cut} THEN {q(g)}" for cut, g in K.SCORE_GRADE_CUTOFFS)
    return f"CASE {whens} ELSE 'CCC' END"


def imean(c: str) -> str:
    return f"(CAST(sum({c}) AS DOUBLE) / count({c}))"


def dmean(c: str, p: int, s: int) -> str:
    return f"(CAST(sum(CAST({c} AS DECIMAL({p},{s}))) AS DOUBLE) / count({c}))"


def itrunc(expr: str) -> str:
    return f"CAST(trunc({expr}) AS BIGINT)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------
_PDM = {"AAA": 10, "AA": 20, "A": 40, "BBB": 70, "BB": 120, "B": 200, "CCC": 350}

LOANS_CTE = f"""
lf_base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_totalprice, o.o_orderpriority,
         c.c_nationkey, c.c_acctbal, c.c_mktsegment
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
lf_h0 AS (SELECT *, (k * 7919 + ck * 104729) % 1000003 AS h0 FROM lf_base),
lf_h1 AS (SELECT *, (h0 * 48271) % 2147483647 AS h1 FROM lf_h0),
lf_h2 AS (SELECT *, (h1 * 48271) % 2147483647 AS h2 FROM lf_h1),
lf_h3 AS (SELECT *, (h2 * 48271) % 2147483647 AS h3 FROM lf_h2),
lf_h4 AS (SELECT *, (h3 * 48271) % 2147483647 AS h4 FROM lf_h3),
lf_h5 AS (SELECT *, (h4 * 48271) % 2147483647 AS h5 FROM lf_h4),
lf_h6 AS (SELECT *, (h5 * 48271) % 2147483647 AS h6 FROM lf_h5),
lf_a AS (
  SELECT *,
    printf('LN-%06d', k + 1) AS loan_id,
    {case_index('c_nationkey % 4', K.GEOGRAPHIES)} AS geography,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Salaried' WHEN 'BUILDING' THEN 'Self-Employed'
      WHEN 'FURNITURE' THEN 'Gig Worker' WHEN 'HOUSEHOLD' THEN 'Small Business' ELSE 'Informal' END
      AS employment_type,
    CAST(540 + h1 % 361 AS BIGINT) AS credit_score,
    CAST(floor(20000 + (c_acctbal + 1000) * 10) AS BIGINT) AS income_proxy,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Personal Loan' WHEN '2' THEN 'SME Working Capital'
      WHEN '3' THEN 'BNPL' WHEN '4' THEN 'Unsecured Consumer' ELSE 'Micro Loan' END AS product_type,
    CAST(floor(o_totalprice) AS BIGINT) AS loan_size,
    CAST({case_index('h2 % 5', K.TENURES)} AS INTEGER) AS tenure_months
  FROM lf_h6),
lf_b AS (SELECT *, {grade_of('credit_score')} AS credit_quality FROM lf_a),
lf_c AS (
  SELECT *,
    ({case_map('credit_quality', _PDM)}) AS pdm,
    ({case_map('credit_quality', K.GRADE_BASE_RATE)}) AS base_rate
  FROM lf_b),
lf_d AS (
  SELECT *,
    (h3 % 1000) < pdm AS is_def,
    NOT ((h3 % 1000) < pdm) AND (h4 % 1000) * 2 < pdm * 5 AS is_del
  FROM lf_c),
lf_e AS (
  SELECT loan_id, geography, employment_type, credit_score, income_proxy, credit_quality, product_type,
    loan_size, tenure_months,
    CAST(base_rate * 100 + (h6 % 201) - 100 AS DOUBLE) / 100 AS pricing_rate,
    {CLIP('CAST(loan_size AS DOUBLE) / (income_proxy * 12 * 0.4e0)', '0e0', '3e0')} AS ltv_ratio,
    {CLIP('CAST(loan_size AS DOUBLE) / tenure_months / income_proxy', '0e0', '0.8e0')} AS dti_ratio,
    CASE WHEN is_def THEN 'Default' WHEN is_del THEN 'DPD30+' ELSE 'Current' END AS delinquency_status,
    CASE WHEN is_def THEN 'Default' WHEN is_del THEN 'At-Risk' ELSE 'Active' END AS loan_status,
    CAST(10 + h2 % 81 AS DOUBLE) / 100 AS cashflow_consistency,
    CAST(5 + h4 % 81 AS DOUBLE) / 100 AS balance_volatility,
    CAST((h6 % 100) < 15 AS INTEGER) AS spending_shock,
    {case_index('h5 % 5', K.CHANNELS)} AS acquisition_channel,
    CAST(h5 % 24 AS INTEGER) AS origination_month,
    'C' || CAST(CAST(floor(CAST(h5 % 24 AS INTEGER) / 6e0) + 1 AS INTEGER) AS VARCHAR) AS cohort,
    CAST(is_def AS INTEGER) AS default_indicator
  FROM lf_d),
loans AS (
  SELECT *,
    {R("loan_size * pricing_rate / 100 * (CASE WHEN default_indicator = 1 THEN -0.4e0 ELSE 0.8e0 END)", 2)}
      AS value_proxy
  FROM lf_e)
"""

def _grade_pd(col: str = "credit_quality") -> str:
    whens = " ".join(f"WHEN {q(g)} THEN {v}e0" for g, v in K.RULE_GRADE_PD.items())
    return f"(CASE {col} {whens} ELSE {K.RULE_UNKNOWN_GRADE_PD}e0 END)"


RULE_PD_RAW = (f"{CLIP(_grade_pd() + ' + ' + CLIP('dti_ratio', '0e0', '0.8e0') + ' / 0.8e0 * 0.15e0 + '
                       + CLIP('(750 - ' + CLIP('credit_score', '300', '900') + ') / 750e0 * 0.1e0', '0e0', '0.1e0'),
                       '0e0', '1e0')}")
RULE_PD = R(f"CASE WHEN default_indicator = 1 THEN 1e0 ELSE {RULE_PD_RAW} END", 4)
EW_BASE = ("(1e0 - " + CLIP("cashflow_consistency", "0e0", "1e0") + ") * 30e0 + "
           + CLIP("balance_volatility", "0e0", "1e0") + " * 25e0 + CAST(spending_shock AS DOUBLE) * 20e0 + "
           + CLIP("dti_ratio", "0e0", "0.8e0") + " / 0.8e0 * 25e0")
RULE_EW = R(CLIP(EW_BASE + " + CASE WHEN default_indicator = 1 THEN 30e0 "
                 "WHEN delinquency_status = 'DPD30+' THEN 15e0 ELSE 0e0 END", "0e0", "100e0"), 1)

SCORED_CTE = LOANS_CTE + f""",
scored AS (
  SELECT *, {RULE_PD} AS default_prob, {RULE_EW} AS early_warning_score, 0 AS cluster FROM loans)
"""


def with_scored(body: str) -> str:
    return "WITH " + SCORED_CTE + body


def with_loans(body: str) -> str:
    return "WITH " + LOANS_CTE + body


# ---------------------------------------------------------------------------
# Report fragments
# ---------------------------------------------------------------------------
SEGMENT_AGGS = f"""
    count(loan_id) AS "count",
    {big('sum(loan_size)')} AS "totalDisbursed",
    {R(imean('default_indicator') + ' * 1e2', 1)} AS "defaultRate",
    {itrunc(imean('credit_score'))} AS "avgScore",
    {R(dmean('pricing_rate', 9, 2), 2)} AS "avgPricing",
    {R(dmean('default_prob', 9, 4) + ' * 1e2', 2)} AS "avgDefaultProb"
"""


def segment_sql(key: str, src: str = "scored") -> str:
    return (f"SELECT CAST({key} AS VARCHAR) AS segment, {SEGMENT_AGGS} FROM {src} "
            f"WHERE {key} IS NOT NULL GROUP BY {key}")


def segments_query(key: str) -> str:
    return with_scored(segment_sql(key))


# ---------------------------------------------------------------------------
# Messy upload and its normalisation
# ---------------------------------------------------------------------------
def _cyc(mod: int, cases: dict, other: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in cases.items())
    return f"CASE n % {mod} {whens} ELSE {other} END"


RAW_LOANS_CTE = LOANS_CTE + f""",
rl_n AS (SELECT *, CAST(substr(loan_id, 4) AS BIGINT) AS n FROM loans),
raw_loans AS (
  SELECT loan_id,
    CAST(loan_size AS VARCHAR) AS loan_amount,
    CASE WHEN n % 29 = 0 THEN NULL WHEN n % 31 = 0 THEN 'abc' ELSE CAST(credit_score AS VARCHAR) END AS cibil_score,
    {_cyc(11, {0: "lower(credit_quality)", 1: "' ' || credit_quality || ' '", 2: "'prime'", 3: "'Good'",
               4: "'poor'", 5: "'unknown'", 6: "NULL", 7: "'MEDIUM'"}, "credit_quality")} AS risk_grade,
    {_cyc(7, {0: "'urban'", 1: "' tier_2 '", 2: "'SEMI URBAN'", 3: "'village'", 4: "NULL", 5: "' Coastal '"},
          "geography")} AS region,
    {_cyc(8, {0: "'self_employed'", 1: "' SALARY'", 2: "'freelancer'", 3: "'sme'", 4: "'daily wage'", 5: "NULL",
              6: "'Pensioner'"}, "employment_type")} AS employment,
    {_cyc(6, {0: "'PL'", 1: "'buy now pay later'", 2: "'microloan'", 3: "NULL", 4: "'Gold Loan '"},
          "product_type")} AS product,
    CASE WHEN n % 37 = 0 THEN '1,200' ELSE CAST(CAST(pricing_rate AS DECIMAL(9,2)) AS VARCHAR) END AS interest_rate,
    {_cyc(9, {0: "CASE WHEN default_indicator = 1 THEN 'YES' ELSE 'no' END",
              1: "CASE WHEN default_indicator = 1 THEN ' npa ' ELSE 'N' END",
              2: "CASE WHEN default_indicator = 1 THEN 'True' ELSE 'false' END"},
          "CASE WHEN default_indicator = 1 THEN '1' ELSE '0' END")} AS is_default,
    {_cyc(10, {0: "'0'", 1: "'45'", 2: "'Overdue'", 3: "NULL", 4: "'CURRENT'", 5: "'DPD90'", 6: "'30+ days'",
               7: "'closed'"}, "delinquency_status")} AS dpd,
    CASE WHEN n % 41 = 0 THEN NULL ELSE CAST(tenure_months AS VARCHAR) END AS tenure,
    {_cyc(5, {0: "'ONLINE'", 1: "'fintech '", 2: "'bc'", 3: "NULL"}, "acquisition_channel")} AS channel,
    CASE WHEN n % 43 = 0 THEN '' ELSE CAST(income_proxy AS VARCHAR) END AS income,
    CAST(CAST(dti_ratio AS DECIMAL(9,4)) AS VARCHAR) AS dti
  FROM rl_n)
"""

WS = ("[ \\t\\r\\n\\f\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
      "\\x{205f}\\x{3000}]")
NUMERIC_RE_SQL = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def NUM(x: str) -> str:
    s = f"lower({STRIP(x)})"
    return f"(CASE WHEN regexp_matches({s}, '{NUMERIC_RE_SQL}') THEN TRY_CAST({s} AS DOUBLE) END)"


def ALIAS(x: str, mapping: dict) -> str:
    return case_map(x, mapping)


def _norm_chain(src: str = "raw_loans") -> str:
    grade_s = f"lower({STRIP('credit_quality')})"
    grade = (f"coalesce({ALIAS(grade_s, K.GRADE_ALIASES)}, "
             f"CASE WHEN upper({grade_s}) IN ({', '.join(q(g) for g in K.GRADES)}) THEN upper({grade_s}) END)")

    def cat(c, mapping):
        return f"coalesce({ALIAS('lower(' + STRIP(c) + ')', mapping)}, {STRIP(c)})"
    flag_s = f"lower({STRIP('default_indicator')})"
    flag = (f"CASE WHEN {flag_s} IN ({', '.join(q(v) for v in K.DEFAULT_FLAG_TRUE)}) "
            f"OR {NUM('default_indicator')} = 1 THEN 1 ELSE 0 END")
    raw = f"lower({STRIP('delinquency_status')})"
    marker = " OR ".join(f"contains({raw}, {q(m)})" for m in K.DELINQUENT_MARKERS)
    delinq = (f"CASE WHEN default_indicator = 1 THEN 'Default' WHEN {marker} THEN 'DPD30+' "
              f"WHEN {raw} IS NULL OR contains({raw}, 'current') OR {raw} = '0' OR {raw} = 'nan' THEN 'Current' "
              f"WHEN {NUM(raw)} > 0 THEN 'DPD30+' ELSE 'Current' END")
    numerics = ", ".join(
        f"coalesce({NUM(c)}, {float(d)}e0) AS {c}" if c in _RAW_NUMERIC else f"{float(d)}e0 AS {c}"
        for c, d in K.NUMERIC_DEFAULTS.items())
    strings = ", ".join(f"coalesce({STRIP(c)}, {q(d)}) AS {c}" for c, d in K.STRING_DEFAULTS.items())
    return f""",
nm_headers AS (
  SELECT loan_id, loan_amount AS loan_size, cibil_score AS credit_score, risk_grade AS credit_quality,
    region AS geography, employment AS employment_type, product AS product_type, interest_rate AS pricing_rate,
    is_default AS default_indicator, dpd AS delinquency_status, tenure AS tenure_months,
    channel AS acquisition_channel, income AS income_proxy, dti AS dti_ratio
  FROM {src}),
nm_grade AS (SELECT * REPLACE ({grade} AS credit_quality) FROM nm_headers),
nm_score AS (SELECT * REPLACE (coalesce(credit_quality, {grade_of(NUM('credit_score'))}) AS credit_quality)
  FROM nm_grade),
nm_emp AS (SELECT * REPLACE ({cat('employment_type', K.EMPLOYMENT_ALIASES)} AS employment_type) FROM nm_score),
nm_prod AS (SELECT * REPLACE ({cat('product_type', K.PRODUCT_ALIASES)} AS product_type) FROM nm_emp),
nm_geo AS (SELECT * REPLACE ({cat('geography', K.GEOGRAPHY_ALIASES)} AS geography) FROM nm_prod),
nm_chan AS (SELECT * REPLACE ({cat('acquisition_channel', K.CHANNEL_ALIASES)} AS acquisition_channel) FROM nm_geo),
nm_flag AS (SELECT * REPLACE ({flag} AS default_indicator) FROM nm_chan),
nm_delinq AS (SELECT * REPLACE ({delinq} AS delinquency_status) FROM nm_flag),
nm_status AS (SELECT *, CASE WHEN default_indicator = 1 THEN 'Default'
  WHEN delinquency_status = 'DPD30+' THEN 'At-Risk' ELSE 'Active' END AS loan_status FROM nm_delinq),
nm_num AS (SELECT loan_id, credit_quality, geography, employment_type, product_type, acquisition_channel,
  default_indicator, delinquency_status, loan_status, {numerics} FROM nm_status),
nm_str AS (SELECT * REPLACE ({strings}) FROM nm_num),
nm_final AS (
  SELECT *,
    'C' || CAST(CAST(floor(trunc(origination_month) / 6e0) + 1 AS BIGINT) AS VARCHAR) AS cohort,
    {R("loan_size * pricing_rate / 100 * (CASE WHEN default_indicator = 1 THEN -0.4e0 ELSE 0.8e0 END)", 2)}
      AS value_proxy
  FROM nm_str)
"""


_RAW_NUMERIC = {"loan_size", "credit_score", "pricing_rate", "income_proxy", "tenure_months", "dti_ratio"}
NORMALIZE_CTE = RAW_LOANS_CTE + _norm_chain()


def with_normalized(body: str) -> str:
    return "WITH " + NORMALIZE_CTE + body


# The upload with fractional amounts and scores and three-decimal rates.
UPLOAD_CTE = RAW_LOANS_CTE + """,
raw_upload AS (
  SELECT * EXCLUDE (n) REPLACE (
    loan_amount || CASE n % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END AS loan_amount,
    CASE WHEN n % 3 = 0 AND cibil_score <> 'abc' THEN cibil_score || '.9' ELSE cibil_score END AS cibil_score,
    CASE WHEN n % 37 <> 0 THEN interest_rate || '5' ELSE interest_rate END AS interest_rate)
  FROM (SELECT *, CAST(substr(loan_id, 4) AS BIGINT) AS n FROM raw_loans))
""" + _norm_chain("raw_upload") + f""",
scored AS (SELECT *, {RULE_PD} AS default_prob, {RULE_EW} AS early_warning_score FROM nm_final)
"""


def with_upload(body: str) -> str:
    return "WITH " + UPLOAD_CTE + body


def usum(c: str) -> str:
    return f"sum(CAST({c} AS DECIMAL(28,8)))"


def umean(c: str) -> str:
    return f"(CAST({usum(c)} AS DOUBLE) / count({c}))"


# The upload that goes through a CSV file: a no-break space after some regions, and a note of two lines.
CSV_CTE = RAW_LOANS_CTE + """,
raw_csv AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(loan_id, 4) AS BIGINT) % 13 = 0 THEN region || chr(160) ELSE region END
                    AS region) FROM raw_loans)
""" + _norm_chain("raw_csv")
