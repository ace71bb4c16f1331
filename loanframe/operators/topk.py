"""Watch-lists: ordered top-k over active loans.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps
only its local top n and the final merge sees n x tasks rows, so the cost
is one scan whatever the table size. Ties on the score are broken by
loan_id so the list is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rnd
from pyspark.sql.window import Window



def _order():
    return [F.col("early_warning_score").desc(), F.col("loan_id").asc()]

_FLOATS = ["early_warning_score", "cashflow_consistency", "dti_ratio", "default_prob"]


def _shape(df: DataFrame) -> DataFrame:
    cols = []
    for c in K.EARLY_WARNING_COLUMNS:
        if c not in df.columns:
            continue  # a missing column is dropped from the list, not an error
        if c == "spending_shock":
            cols.append((F.col(c) != 0).alias(c))
        elif c in _FLOATS:
            cols.append(rnd(F.col(c).cast("double"), 4).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _active_first_top(scored: DataFrame, n: int) -> DataFrame:
    """Top ``n`` of active-or-all (F1) in one pass.

    Rank Active loans ahead of the rest, take the first ``n`` (one
    TakeOrderedAndProject), then drop the non-Active rows if any Active row
    made the list. If the book has an Active loan, the first ranked row is
    Active, so this equals "top n of the Active loans, or of all loans when
    none is Active" without a second scan for the fallback test. The window
    runs over the ``n`` kept rows only.
    """
    active = (F.col("loan_status") == "Active").cast("int")
    top = scored.withColumn("_act", active).orderBy(F.col("_act").desc(), *_order()).limit(n)
    top = top.withColumn("_any", F.max("_act").over(Window.partitionBy()))
    return top.where((F.col("_act") == 1) | (F.col("_any") == 0)).drop("_act", "_any")


def early_warning_signals(scored: DataFrame, top_n: int = K.WATCHLIST_SIZE) -> DataFrame:
    """The ``top_n`` highest early-warning scores among Active loans (all
    loans when none is Active), with the watch-list columns."""
    return _shape(_active_first_top(scored, top_n).orderBy(*_order()))


def early_warning_by_grade(scored: DataFrame, grade: str, depth: int | None = None,
                           top_n: int = K.WATCHLIST_SIZE) -> DataFrame:
    """The ``top_n`` highest scores of one grade among active-or-all loans.

    The grade is filtered first, so a grade's list is full whenever it has
    enough loans. Whether the book has an Active loan at all is settled over
    all grades: an inactive loan is listed only when there is none.
    ``depth``, if given, looks at the book's first ``depth`` loans only.
    """
    if depth is not None:
        top = _active_first_top(scored, depth)
        return _shape(top.where(F.col("credit_quality") == grade).orderBy(*_order()).limit(top_n))
    active = F.col("loan_status") == "Active"
    listed = scored.where(active & (F.col("credit_quality") == grade)).orderBy(*_order()).limit(top_n)
    # Read only when the book has no Active loan; the test stops at the first one.
    rest = scored.where(~scored.where(active).select(F.lit(1)).limit(1).exists()
                        & (F.col("credit_quality") == grade)).orderBy(*_order()).limit(top_n)
    return _shape(listed.unionByName(rest).orderBy(*_order()).limit(top_n))
