"""Fixed domain values.

Everything in this module is a fixed value that must equal the behaviour
being reproduced (grade ladders, alias tables, defaults, thresholds). They
are kept together, in their natural order, for every operator. The oracles
have a copy of their own.
"""

# ---------------------------------------------------------------------------
# Categorical domains
# ---------------------------------------------------------------------------
GEOGRAPHIES = ["Metro", "Tier-2", "Semi-Urban", "Rural"]
EMPLOYMENT_TYPES = ["Salaried", "Self-Employed", "Gig Worker", "Small Business", "Informal"]
PRODUCT_TYPES = ["Personal Loan", "SME Working Capital", "BNPL", "Unsecured Consumer", "Micro Loan"]
CHANNELS = ["Digital-Direct", "Partner-Fintech", "Agent Network", "NBFC-BC", "Social Media"]
GRADES = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC"]

# ---------------------------------------------------------------------------
# Derived loans
# ---------------------------------------------------------------------------
GRADE_BASE_RATE = {"AAA": 10, "AA": 12, "A": 14, "BBB": 16, "BB": 19, "B": 22, "CCC": 26}
TENURES = [6, 12, 18, 24, 36]

# ---------------------------------------------------------------------------
# Rule scoring
# ---------------------------------------------------------------------------
RULE_GRADE_PD = {"AAA": 0.01, "AA": 0.02, "A": 0.04, "BBB": 0.07, "BB": 0.12, "B": 0.20, "CCC": 0.38}
RULE_UNKNOWN_GRADE_PD = 0.10
# Score -> grade cut-offs, highest first; below the last one is CCC.
SCORE_GRADE_CUTOFFS = [(800, "AAA"), (760, "AA"), (720, "A"), (680, "BBB"), (640, "BB"), (600, "B")]
INDUSTRY_DEFAULT_BENCHMARK = 8.0

# ---------------------------------------------------------------------------
# Normalisation of uploaded tables
# ---------------------------------------------------------------------------
COLUMN_ALIASES = {
    "loan_amount": "loan_size", "amount": "loan_size", "principal": "loan_size",
    "disbursed_amount": "loan_size", "sanctioned_amount": "loan_size",
    "cibil_score": "credit_score", "cibil": "credit_score", "bureau_score": "credit_score",
    "interest_rate": "pricing_rate", "rate": "pricing_rate", "roi": "pricing_rate", "irr": "pricing_rate",
    "risk_grade": "credit_quality", "grade": "credit_quality", "rating": "credit_quality",
    "region": "geography", "location": "geography", "tier": "geography",
    "employment": "employment_type", "job_type": "employment_type",
    "product": "product_type", "loan_type": "product_type", "scheme": "product_type",
    "is_default": "default_indicator", "default": "default_indicator", "npa": "default_indicator",
    "bad_flag": "default_indicator",
    "dpd": "delinquency_status", "dpd_bucket": "delinquency_status", "days_past_due": "delinquency_status",
    "tenure": "tenure_months", "term": "tenure_months", "months": "tenure_months",
    "channel": "acquisition_channel", "source": "acquisition_channel",
    "income": "income_proxy", "salary": "income_proxy", "monthly_income": "income_proxy",
    "dti": "dti_ratio", "foir": "dti_ratio",
    "ltv": "ltv_ratio",
    "month": "origination_month", "disbursement_month": "origination_month",
    "vintage": "cohort",
    "cashflow": "cashflow_consistency", "cf_score": "cashflow_consistency",
    "balance_vol": "balance_volatility",
    "shock": "spending_shock",
}

GRADE_ALIASES = {
    "aaa": "AAA", "aa": "AA", "a": "A", "bbb": "BBB",
    "bb": "BB", "b": "B", "ccc": "CCC",
    "investment": "AAA", "prime": "AAA", "good": "A", "fair": "BBB",
    "poor": "CCC", "bad": "CCC", "high": "CCC", "medium": "BBB", "low": "AA",
}

EMPLOYMENT_ALIASES = {
    "self_employed": "Self-Employed", "self employed": "Self-Employed",
    "selfemployed": "Self-Employed", "self-employed": "Self-Employed",
    "salaried": "Salaried", "salary": "Salaried",
    "gig": "Gig Worker", "gig_worker": "Gig Worker", "freelancer": "Gig Worker",
    "small_business": "Small Business", "small business": "Small Business",
    "business": "Small Business", "sme": "Small Business",
    "informal": "Informal", "daily_wage": "Informal", "daily wage": "Informal",
}

PRODUCT_ALIASES = {
    "personal loan": "Personal Loan", "personal_loan": "Personal Loan", "pl": "Personal Loan",
    "sme working capital": "SME Working Capital", "sme_working_capital": "SME Working Capital",
    "working capital": "SME Working Capital", "sme": "SME Working Capital",
    "bnpl": "BNPL", "buy now pay later": "BNPL",
    "unsecured consumer": "Unsecured Consumer", "consumer loan": "Unsecured Consumer",
    "micro loan": "Micro Loan", "micro_loan": "Micro Loan", "microloan": "Micro Loan",
}

GEOGRAPHY_ALIASES = {
    "metro": "Metro", "urban": "Metro", "city": "Metro",
    "tier-2": "Tier-2", "tier2": "Tier-2", "tier 2": "Tier-2", "tier_2": "Tier-2",
    "semi-urban": "Semi-Urban", "semi_urban": "Semi-Urban", "semi urban": "Semi-Urban",
    "rural": "Rural", "village": "Rural",
}

CHANNEL_ALIASES = {
    "digital-direct": "Digital-Direct", "digital": "Digital-Direct", "online": "Digital-Direct",
    "app": "Digital-Direct",
    "partner-fintech": "Partner-Fintech", "fintech": "Partner-Fintech", "partner": "Partner-Fintech",
    "agent network": "Agent Network", "agent_network": "Agent Network", "agent": "Agent Network",
    "nbfc-bc": "NBFC-BC", "nbfc": "NBFC-BC", "bc": "NBFC-BC",
    "social media": "Social Media", "social_media": "Social Media", "social": "Social Media",
}

DEFAULT_FLAG_TRUE = ["1", "yes", "true", "y", "default", "defaulted", "npa"]
DELINQUENT_MARKERS = ["dpd30", "dpd 30", "dpd+", "overdue", "delinquent", "past due", "30+"]

NUMERIC_DEFAULTS = {
    "loan_size": 100000, "credit_score": 680, "pricing_rate": 15,
    "income_proxy": 50000, "tenure_months": 12, "ltv_ratio": 0.5,
    "dti_ratio": 0.3, "cashflow_consistency": 0.7, "balance_volatility": 0.3,
    "spending_shock": 0, "origination_month": 0,
}
STRING_DEFAULTS = {
    "geography": "Metro", "employment_type": "Salaried", "product_type": "Personal Loan",
    "acquisition_channel": "Digital-Direct", "credit_quality": "BBB",
}

# ---------------------------------------------------------------------------
# Model features
# ---------------------------------------------------------------------------
CAT_COLS = ["geography", "employment_type", "product_type", "acquisition_channel", "credit_quality"]
NUM_COLS = ["credit_score", "loan_size", "pricing_rate", "ltv_ratio", "dti_ratio",
            "income_proxy", "tenure_months", "cashflow_consistency", "balance_volatility", "spending_shock"]
RF_WEIGHT, GB_WEIGHT = 0.6, 0.4
PROB_STD_FLOOR = 0.001

# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------
CLUSTER_NAMES = ["Prime Borrowers", "Growth Segment", "Watch List", "High Risk"]
EW_BUCKETS = ["0-20", "20-40", "40-60", "60-80", "80-100"]
GRADE_TIERS = {"AAA": "Investment", "AA": "Investment", "A": "Investment", "BBB": "Investment",
               "BB": "Speculative", "B": "Speculative", "CCC": "Distressed"}
TIER_ORDER = ["Investment", "Speculative", "Distressed"]
EARLY_WARNING_COLUMNS = ["loan_id", "early_warning_score", "credit_quality", "product_type",
                         "geography", "cashflow_consistency", "dti_ratio", "spending_shock",
                         "default_prob", "cluster"]
WATCHLIST_SIZE = 50
CARD_LIST_SIZE = 8

# ---------------------------------------------------------------------------
# Text read as missing in an uploaded CSV (pandas defaults)
# ---------------------------------------------------------------------------
CSV_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                   "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
