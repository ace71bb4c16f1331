"""Fixed values of the oracle statements, written out here so that they do not
share the operators' tables: a wrong entry there no longer passes both sides."""

# Fixed values.
CHANNELS = ['Digital-Direct', 'Partner-Fintech', 'Agent Network', 'NBFC-BC', 'Social Media']
CHANNEL_ALIASES = {'digital-direct': 'Digital-Direct',
 'digital': 'Digital-Direct',
 'online': 'Digital-Direct',
 'app': 'Digital-Direct',
 'partner-fintech': 'Partner-Fintech',
 'fintech': 'Partner-Fintech',
 'partner': 'Partner-Fintech',
 'agent network': 'Agent Network',
 'agent_network': 'Agent Network',
 'agent': 'Agent Network',
 'nbfc-bc': 'NBFC-BC',
 'nbfc': 'NBFC-BC',
 'bc': 'NBFC-BC',
 'social media': 'Social Media',
 'social_media': 'Social Media',
 'social': 'Social Media'}
DEFAULT_FLAG_TRUE = ['1', 'yes', 'true', 'y', 'default', 'defaulted', 'npa']
DELINQUENT_MARKERS = ['dpd30', 'dpd 30', 'dpd+', 'overdue', 'delinquent', 'past due', '30+']
EMPLOYMENT_ALIASES = {'self_employed': 'Self-Employed',
 'self employed': 'Self-Employed',
 'selfemployed': 'Self-Employed',
 'self-employed': 'Self-Employed',
 'salaried': 'Salaried',
 'salary': 'Salaried',
 'gig': 'Gig Worker',
 'gig_worker': 'Gig Worker',
 'freelancer': 'Gig Worker',
 'small_business': 'Small Business',
 'small business': 'Small Business',
 'business': 'Small Business',
 'sme': 'Small Business',
 'informal': 'Informal',
 'daily_wage': 'Informal',
 'daily wage': 'Informal'}
GEOGRAPHIES = ['Metro', 'Tier-2', 'Semi-Urban', 'Rural']
GEOGRAPHY_ALIASES = {'metro': 'Metro',
 'urban': 'Metro',
 'city': 'Metro',
 'tier-2': 'Tier-2',
 'tier2': 'Tier-2',
 'tier 2': 'Tier-2',
 'tier_2': 'Tier-2',
 'semi-urban': 'Semi-Urban',
 'semi_urban': 'Semi-Urban',
 'semi urban': 'Semi-Urban',
 'rural': 'Rural',
 'village': 'Rural'}
GRADES = ['AAA', 'AA', 'A', 'BBB', 'BB', 'B', 'CCC']
GRADE_ALIASES = {'aaa': 'AAA',
 'aa': 'AA',
 'a': 'A',
 'bbb': 'BBB',
 'bb': 'BB',
 'b': 'B',
 'ccc': 'CCC',
 'investment': 'AAA',
 'prime': 'AAA',
 'good': 'A',
 'fair': 'BBB',
 'poor': 'CCC',
 'bad': 'CCC',
 'high': 'CCC',
 'medium': 'BBB',
 'low': 'AA'}
GRADE_BASE_RATE = {'AAA': 10, 'AA': 12, 'A': 14, 'BBB': 16, 'BB': 19, 'B': 22, 'CCC': 26}
NUMERIC_DEFAULTS = {'loan_size': 100000,
 'credit_score': 680,
 'pricing_rate': 15,
 'income_proxy': 50000,
 'tenure_months': 12,
 'ltv_ratio': 0.5,
 'dti_ratio': 0.3,
 'cashflow_consistency': 0.7,
 'balance_volatility': 0.3,
 'spending_shock': 0,
 'origination_month': 0}
PRODUCT_ALIASES = {'personal loan': 'Personal Loan',
 'personal_loan': 'Personal Loan',
 'pl': 'Personal Loan',
 'sme working capital': 'SME Working Capital',
 'sme_working_capital': 'SME Working Capital',
 'working capital': 'SME Working Capital',
 'sme': 'SME Working Capital',
 'bnpl': 'BNPL',
 'buy now pay later': 'BNPL',
 'unsecured consumer': 'Unsecured Consumer',
 'consumer loan': 'Unsecured Consumer',
 'micro loan': 'Micro Loan',
 'micro_loan': 'Micro Loan',
 'microloan': 'Micro Loan'}
RULE_GRADE_PD = {'AAA': 0.01, 'AA': 0.02, 'A': 0.04, 'BBB': 0.07, 'BB': 0.12, 'B': 0.2, 'CCC': 0.38}
RULE_UNKNOWN_GRADE_PD = 0.1
SCORE_GRADE_CUTOFFS = [(800, 'AAA'), (760, 'AA'), (720, 'A'), (680, 'BBB'), (640, 'BB'), (600, 'B')]
STRING_DEFAULTS = {'geography': 'Metro',
 'employment_type': 'Salaried',
 'product_type': 'Personal Loan',
 'acquisition_channel': 'Digital-Direct',
 'credit_quality': 'BBB'}
TENURES = [6, 12, 18, 24, 36]
CARD_LIST_SIZE = 8
CAT_COLS = ['geography', 'employment_type', 'product_type', 'acquisition_channel', 'credit_quality']
NUM_COLS = ['credit_score', 'loan_size', 'pricing_rate', 'ltv_ratio', 'dti_ratio', 'income_proxy', 'tenure_months',
 'cashflow_consistency', 'balance_volatility', 'spending_shock']
CLUSTER_NAMES = ['Prime Borrowers', 'Growth Segment', 'Watch List', 'High Risk']
EW_BUCKETS = ['0-20', '20-40', '40-60', '60-80', '80-100']
INDUSTRY_DEFAULT_BENCHMARK = 8.0
PROB_STD_FLOOR = 0.001
TIER_ORDER = ['Investment', 'Speculative', 'Distressed']
WATCHLIST_SIZE = 50

# Recommendation titles and advice
TITLES = ["Executive Summary", "ML Model — Default Risk Analysis", "Early Warning — Isolation Forest Signals",
          "Geographic Risk Analysis", "Product Portfolio Optimization", "Pricing & ROI Recommendation"]
MEMO_TITLES = ["Executive Summary", "ML Model Insights — Default Risk", "Early Warning — Isolation Forest Signals",
               "K-Means Customer Segmentation", "Pricing Optimization", "Portfolio Diversification"]
CCC_ACTION = ("Action: Halt new CCC originations. Tighten underwriting for BB/B-grade loans "
              "(DTI > 0.4 or LTV > 1.5).")
EW_ACTION = "Action: Deploy automated nudges at DPD-7, personal outreach at DPD-15."
PRICING_FLOOR = "Risk-adjusted pricing floor: Rate = Base + (PD × LGD × 100)."
PRICING_ACTION = "Action: Re-price BB/B segments upward by 2–3%. Prioritise high-margin, low-risk originations."
MEMO_CCC_ADVICE = ("Recommendation: Halt new CCC originations and tighten underwriting for BB-grade loans "
                   "(DTI > 0.4 or LTV > 1.5).")
MEMO_EW_ADVICE = ("Deploy automated SMS nudges at DPD-7 and personal outreach at DPD-15. "
                  "Target: reduce DPD-30+ roll rate by 30% in 2 quarters.")
MEMO_KMEANS = ("K-Means (k=4) segmented portfolio into: Prime Borrowers, Growth Segment, Watch List, High Risk. "
               "Prime cluster shows lowest early warning scores — increase credit limits by 15-20%. "
               "High Risk cluster: tighten DTI ceiling to 0.35 and require additional income proof.")
MEMO_PRICING = ("Risk-adjusted floor model: Rate = Base + (PD × LGD × 100). "
                "BB/B segments appear under-priced by 2-3%. "
                "Increase BNPL originations for A-grade+ borrowers — highest risk-adj. margin.")
MEMO_DIVERSIFY = ("Maintain SME ≤ 40% of portfolio. Grow BNPL and Unsecured Consumer segments. "
                  "Partner-Fintech channel shows lowest cost of acquisition — prioritise 2:1 over Agent Network.")
