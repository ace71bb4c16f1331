"""Degenerate-model guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rnd


def prob_guard(df: DataFrame, prob: str) -> DataFrame:
    """One row: population std of the predictions and which branch scoring
    takes ('rules' when the std is below the floor, i.e. the model predicts a
    near-constant probability)."""
    return df.agg(F.stddev_pop(F.col(prob)).alias("_std")).select(
        rnd(F.col("_std"), 6).alias("prob_std"),
        F.when(F.col("_std") < K.PROB_STD_FLOOR, F.lit("rules")).otherwise(F.lit("model")).alias("branch"))
