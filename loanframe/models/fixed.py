"""Models of fixed numbers, so that scoring, prediction and reports are checked by value.

They go through the same code as fitted models: a :class:`LoanModels` bundle
whose parts are native expressions and a small isolation forest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, rnd
from ..operators import scoring as S
from .bundle import LoanModels
from .compiled import Boosting, Centres, Forest, Multinomial, Split
from .features import FeatureEncoder, hyperparams
from .isoforest import NODE_SCHEMA, IsolationForestModel

FEATURES = ["credit_score", "dti_ratio", "balance_volatility"]
# Tree, node, feature (-1: leaf), threshold, left, right, rows, depth.
NODES = [
    (0, 0, 0, 640.0, 1, 2, 256, 0), (0, 1, 1, 0.35, 3, 4, 70, 1), (0, 2, -1, 0.0, -1, -1, 186, 1),
    (0, 3, -1, 0.0, -1, -1, 66, 2), (0, 4, -1, 0.0, -1, -1, 4, 2),
    (1, 0, 2, 0.8, 1, 2, 256, 0), (1, 1, -1, 0.0, -1, -1, 254, 1), (1, 2, 0, 700.0, 3, 4, 2, 1),
    (1, 3, -1, 0.0, -1, -1, 1, 2), (1, 4, -1, 0.0, -1, -1, 1, 2),
]
OFFSET = -0.5

# Fixed values of the bundle. Semi-Urban and CCC have no label: they count as unseen.
LABELS = {
    "geography": ["Metro", "Rural", "Tier-2"],
    "employment_type": ["Gig Worker", "Informal", "Salaried", "Self-Employed", "Small Business"],
    "product_type": ["BNPL", "Micro Loan", "Personal Loan", "SME Working Capital", "Unsecured Consumer"],
    "acquisition_channel": ["Agent Network", "Digital-Direct", "NBFC-BC", "Partner-Fintech", "Social Media"],
    "credit_quality": ["A", "AA", "AAA", "B", "BB", "BBB"],
}
MEANS = [0.0, 0.0, 0.0, 0.0, 0.0, 700.0, 150000.0, 15.0, 1.0, 0.3, 60000.0, 24.0, 0.5, 0.4, 0.0]
SCALES = [1.0, 1.0, 1.0, 1.0, 1.0, 100.0, 100000.0, 5.0, 0.5, 0.2, 20000.0, 12.0, 0.25, 0.2, 1.0]
# _z1 employment, _z4 grade, _z5 credit score, _z7 rate, _z9 dti, _z12 cashflow, _z13 balance volatility
FOREST = Forest((
    Split("_z5", -0.6, Split("_z9", 0.25, 0.18, 0.42), 0.05),
    Split("_z4", 2.0, 0.08, Split("_z13", 1.0, 0.15, 0.33)),
    Split("_z7", 0.8, 0.06, 0.27),
))
BOOSTING = Boosting((Split("_z5", 0.0, -0.7, -1.1), Split("_z9", 0.5, -0.3, 0.9), Split("_z1", 1.0, 0.4, -0.2)), (1.0, 0.1, 0.1))
# The last centre equals the second, which wins the tie.
CENTRES = Centres(("_z5", "_z9", "_z12", "_z13"), (
    (0.5, -0.5, 0.4, -0.5), (-0.5, 0.5, -0.4, 0.5), (1.2, -1.0, 1.0, -1.0), (-1.5, 1.5, -0.8, 1.2), (-0.5, 0.5, -0.4, 0.5)))
GRADE_LABELS = ["A", "AA", "AAA", "B", "BB", "BBB", "CCC"]
GRADE_MODEL = Multinomial(("_z5", "_z7", "_z9"), (
    (0.4, -0.3, -0.1), (0.9, -0.6, -0.1), (1.5, -0.9, -0.2), (-0.9, 0.5, 0.1), (-0.4, 0.3, 0.0), (0.0, 0.0, 0.0), (-1.4, 0.9, 0.3)),
    (0.2, 0.0, -0.5, -0.2, 0.1, 0.3, -0.7))
# The nodes above over the 15 standardised features.
STD_NODES = [
    (0, 0, 5, -0.6, 1, 2, 256, 0), (0, 1, 9, 0.25, 3, 4, 70, 1), (0, 2, -1, 0.0, -1, -1, 186, 1),
    (0, 3, -1, 0.0, -1, -1, 66, 2), (0, 4, -1, 0.0, -1, -1, 4, 2),
    (1, 0, 13, 2.0, 1, 2, 256, 0), (1, 1, -1, 0.0, -1, -1, 254, 1), (1, 2, 5, 0.0, 3, 4, 2, 1),
    (1, 3, -1, 0.0, -1, -1, 1, 2), (1, 4, -1, 0.0, -1, -1, 1, 2),
]


def fixed_forest(nodes: list[tuple] | None = None) -> IsolationForestModel:
    model = IsolationForestModel.from_nodes(pd.DataFrame(nodes or NODES, columns=NODE_SCHEMA.names), 256)
    model.offset = OFFSET
    return model


def fixed_models() -> LoanModels:
    """The bundle of the fixed values above."""
    return LoanModels(FeatureEncoder.of_labels(LABELS, MEANS, SCALES), hyperparams(1000), 1000, False, rf=FOREST, gbt=BOOSTING,
                      iso=fixed_forest(STD_NODES), kmeans=CENTRES, grade_lr=GRADE_MODEL, grade_labels=GRADE_LABELS, prob_std=1.0)


def anomaly_scores_fixed(loans: DataFrame) -> DataFrame:
    """M6 with the fixed forest, and R4 with its anomaly bonus on the rule probability."""
    x = [F.col(c).cast("double").alias(c) for c in FEATURES]
    model = fixed_forest()
    scored = loans.withColumn("_s", model.score_udf()(F.struct(*x)))
    decision = F.col("_s") - F.lit(OFFSET)
    bonus = clip(-decision, 0.0, 1.0) * F.lit(10.0)
    return scored.select("loan_id", rnd("_s", 6).alias("score"), rnd(decision, 6).alias("decision"),
                         S.ew_blend(S.rule_default_prob(), bonus).alias("early_warning_score"))


def probabilities_fixed(loans: DataFrame) -> DataFrame:
    """M3 and M4: the forest's and the boosted trees' own probabilities, 6 decimals."""
    feat = fixed_models().featurize(loans)
    return feat.select("loan_id", rnd(FOREST.probability(), 6).alias("forest_prob"),
                       rnd(BOOSTING.probability(), 6).alias("boosting_prob"))
