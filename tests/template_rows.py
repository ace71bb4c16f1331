"""The five-row template of an upload (fixed test data)."""

from loanframe.sources.fixtures import RAW_COLUMNS

# Fixed values.
TEMPLATE_HEADER = RAW_COLUMNS
TEMPLATE_ROWS = [
    ["LN-000001", "150000", "720", "A", "Metro", "Salaried", "Personal Loan", "14.5", "0", "Current", "12",
     "Digital-Direct", "55000", "0.25"],
    ["LN-000002", "500000", "680", "BBB", "Tier-2", "Self-Employed", "SME Working Capital", "16.0", "0", "Current",
     "24", "Partner-Fintech", "80000", "0.35"],
    ["LN-000003", "25000", "620", "B", "Rural", "Gig Worker", "Micro Loan", "22.0", "1", "Default", "6",
     "Agent Network", "20000", "0.45"],
    ["LN-000004", "80000", "760", "AA", "Metro", "Salaried", "Unsecured Consumer", "12.5", "0", "Current", "18",
     "Digital-Direct", "70000", "0.20"],
    ["LN-000005", "15000", "580", "CCC", "Semi-Urban", "Informal", "BNPL", "26.0", "1", "DPD30+", "3",
     "Social Media", "15000", "0.60"],
]


def sample_template(spark):
    """The five-row sample upload (all strings, template headers)."""
    return spark.createDataFrame(TEMPLATE_ROWS, schema=", ".join(f"`{c}` string" for c in TEMPLATE_HEADER))
