"""Model features.

* Categoricals are label-encoded in alphabetical order (``StringIndexer``
  with ``alphabetAsc``); a value unseen at fit time maps to index 0, an
  absent column to 0.
* Numerics: NULL -> 0.
* Standardisation uses the population standard deviation, mean-centred; a
  constant column scales by 1 (so it becomes 0).

The fitted state is 15 means / deviations from one aggregate and the labels of
each categorical: a list on the driver up to MAX_LABELS distinct values, beyond
that a stored table of codes (distributed dense ranks) that is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranks import dense_codes
from ..session import MAX_BROADCAST_ROWS, materialize

FEATURE_NAMES = [f"cat_{c}" for c in K.CAT_COLS] + K.NUM_COLS
STD_COLS = [f"_z{i}" for i in range(len(FEATURE_NAMES))]
VALUES = "_values"  # the standardised features as an array


@dataclass
class Hyper:
    rf_trees: int
    rf_depth: int
    rf_min_leaf: int
    gb_trees: int
    gb_depth: int
    kmeans_k: int
    lr_c: float


def hyperparams(n: int) -> Hyper:
    """Size-adaptive settings (floor division as in the original)."""
    return Hyper(
        rf_trees=max(10, min(120, n * 5)),
        rf_depth=min(8, max(2, n // 2)),
        rf_min_leaf=max(1, min(3, n // 5)),
        gb_trees=max(10, min(80, n * 3)),
        gb_depth=min(4, max(2, n // 3)),
        kmeans_k=max(1, min(4, n)),
        lr_c=max(0.01, min(1.0, float(n) / 100)),
    )


def hyper_columns(n: Column) -> dict[str, Column]:
    """M11 as columns of a row count."""
    def within(lo, x: Column, hi) -> Column:
        return F.greatest(F.lit(lo), F.least(F.lit(hi), x))

    half, third, fifth = (F.floor(n / F.lit(k)) for k in (2, 3, 5))
    return {"rf_trees": within(10, n * 5, 120), "rf_depth": F.least(F.lit(8), F.greatest(F.lit(2), half)),
            "rf_min_leaf": within(1, fifth, 3), "gb_trees": within(10, n * 3, 80),
            "gb_depth": F.least(F.lit(4), F.greatest(F.lit(2), third)), "kmeans_k": within(1, n, 4),
            "lr_c": within(0.01, n.cast("double") / F.lit(100.0), 1.0)}


def feature_values(df: DataFrame) -> Column:
    """The standardised features of a row as an array, from its column VALUES or the ``features`` vector (each read of
    which converts the whole vector)."""
    return F.col(VALUES) if VALUES in df.columns else vector_to_array(F.col("features"))


MAX_LABELS = 100_000  # labels of one categorical feature that the driver holds


@dataclass
class FeatureEncoder:
    indexer: StringIndexerModel | None = None  # of the categories with few values
    present_cats: list[str] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    codes: dict[str, DataFrame] = field(default_factory=dict)  # (value, code) of the others

    @staticmethod
    def fit(df: DataFrame, max_labels: int = MAX_LABELS) -> "FeatureEncoder":
        enc = FeatureEncoder()
        enc.present_cats = [c for c in K.CAT_COLS if c in df.columns]
        if enc.present_cats:
            # The indexer keeps its labels on the driver: their number is checked first.
            kinds = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in enc.present_cats]).first()
            enc.codes = {c: materialize(dense_codes(df, c), f"codes-{c}") for c in enc.present_cats if kinds[c] > max_labels}
            few = [c for c in enc.present_cats if c not in enc.codes]
            if few:
                enc.indexer = StringIndexer(
                    inputCols=[f"_s_{c}" for c in few], outputCols=[f"_i_{c}" for c in few],
                    stringOrderType="alphabetAsc", handleInvalid="keep").fit(enc._strings(df))
        raw = enc._raw(df)
        stats = raw.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURE_NAMES)],
                        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURE_NAMES)]).first()
        enc.means = [float(stats[f"m{i}"] or 0.0) for i in range(len(FEATURE_NAMES))]
        enc.scales = [float(stats[f"s{i}"]) if stats[f"s{i}"] else 1.0 for i in range(len(FEATURE_NAMES))]
        return enc

    @staticmethod
    def of_labels(labels: dict[str, list[str]], means: list[float], scales: list[float],
                  codes: dict[str, DataFrame] | None = None) -> "FeatureEncoder":
        """An encoder of given labels (codes are places in the lists), means and scales."""
        indexer = None
        if labels:
            indexer = StringIndexerModel.from_arrays_of_labels(list(labels.values()), [f"_s_{c}" for c in labels],
                                                               [f"_i_{c}" for c in labels], "keep")
        codes = codes or {}
        return FeatureEncoder(indexer, [c for c in K.CAT_COLS if c in labels or c in codes], means, scales, codes)

    def _strings(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_s_{c}": F.col(c).cast("string") for c in self.present_cats})

    def _raw(self, df: DataFrame) -> DataFrame:
        """Unscaled feature columns named by FEATURE_NAMES (plus the input)."""
        out = self._strings(df) if self.present_cats else df
        labels = self.labels()
        if self.indexer is not None:
            out = self.indexer.transform(out)
        for c, codes in self.codes.items():
            side = codes.select(F.col("value").alias(f"_s_{c}"), F.col("code").cast("double").alias(f"_i_{c}"))
            small = side.count() <= MAX_BROADCAST_ROWS
            out = out.join(F.broadcast(side) if small else side.hint("merge"), f"_s_{c}", "left")
        cols = {}
        for c in K.CAT_COLS:
            idx = F.coalesce(F.col(f"_i_{c}"), F.lit(0.0)) if c in self.present_cats else F.lit(0.0)
            # An unseen value or a null has the place behind the last label.
            cols[f"cat_{c}"] = F.when(idx >= F.lit(float(len(labels[c]))), F.lit(0.0)).otherwise(idx) if c in labels else idx
        for c in K.NUM_COLS:
            cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        out = out.withColumns(cols)
        return out.drop(*[f"_s_{c}" for c in self.present_cats], *[f"_i_{c}" for c in self.present_cats])

    def standardized(self, df: DataFrame) -> DataFrame:
        """Input columns plus the 15 standardised features ``_z0.._z14``."""
        raw = self._raw(df)
        z = {STD_COLS[i]: (F.col(f) - F.lit(self.means[i])) / F.lit(self.scales[i])
             for i, f in enumerate(FEATURE_NAMES)}
        return raw.withColumns(z).drop(*[f for f in FEATURE_NAMES if f not in df.columns])

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Input columns plus the standardised ``features`` vector (and _z*)."""
        return VectorAssembler(inputCols=STD_COLS, outputCol=out).transform(self.standardized(df))

    def labels(self) -> dict[str, list[str]]:
        """Labels of the categories that the driver holds, in the order of their codes."""
        if self.indexer is None:
            return {}
        few = [c for c in self.present_cats if c not in self.codes]
        return {c: list(lbls) for c, lbls in zip(few, self.indexer.labelsArray)}
