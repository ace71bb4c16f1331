"""Column-level numeric helpers shared by every operator.

All of them build JVM-side expressions (no Python per row), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, n: int) -> Column:
    """Half-to-even rounding via multiply / rint / divide.

    This matches NumPy/pandas rounding exactly (they do the same three IEEE
    steps); ``F.round`` (half-up on decimals) and ``F.bround`` do not.
    """
    scale = float(10 ** n)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lo=None, hi=None) -> Column:
    """NumPy-style clip; bounds may be None."""
    out = col_(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def trunc_long(c) -> Column:
    """Python ``int(x)``: truncation toward zero, as BIGINT."""
    return col_(c).cast("double").cast("long")


def exact_sum(c, precision: int, scale: int) -> Column:
    """Order-independent sum of a value with a known number of decimals.

    Doubles are summed as DECIMAL so the total does not depend on the order
    in which partitions are merged; the result is returned as DOUBLE.
    """
    return F.sum(col_(c).cast(f"decimal({precision},{scale})")).cast("double")


def exact_mean(c, precision: int, scale: int) -> Column:
    """Mean of a fixed-decimal value: decimal sum, then one double division.

    Nulls are skipped, as in pandas.
    """
    return exact_sum(c, precision, scale) / F.count(col_(c)).cast("double")


# Uploaded amounts, rates and scores may carry any number of decimals, so
# they are summed at this shape and rounded or truncated once, at the end.
WIDE = (38, 10)


def wide_total(c) -> Column:
    """``int(sum(x))``: exact sum of the unrounded values, truncated once."""
    return F.sum(col_(c).cast("decimal({},{})".format(*WIDE))).cast("long")


def wide_mean(c) -> Column:
    """Mean of the unrounded values (exact sum, one division), nulls skipped."""
    return exact_mean(c, *WIDE)


def int_mean(c) -> Column:
    """Mean of an integral column such as a 0/1 flag (exact sum, one division), nulls skipped."""
    return F.sum(col_(c).cast("long")).cast("double") / F.count(col_(c)).cast("double")


def rate_pct(flag: Column, digits: int = 1) -> Column:
    """R(mean(flag) * 100, digits) for a 0/1 flag column."""
    return rnd(int_mean(flag) * F.lit(100.0), digits)


def safe_div(num, den) -> Column:
    return col_(num) / F.nullif(col_(den), F.lit(0))


def hash_uniform(*cols, seed: int = 42) -> Column:
    """A deterministic uniform in [0, 1) from the given columns.

    It depends only on the row's values, never on the partitioning, so a
    lost task recomputes exactly the same numbers.
    """
    h = F.xxhash64(F.lit(seed), *[col_(c) for c in cols])
    return F.shiftright(h, 11).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
