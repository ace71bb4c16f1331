"""Ranks, running totals and order statistics over whole tables, at every size the same way.

No window here is ordered over all rows. Rows are range-partitioned by the
order, sorted and written once with their partition and place; a partition's
offset comes from the totals of the partitions before it (one row each), and
what is left to do inside a partition stays there. Ties meet in one row before
the order is taken, so a value that a third of all rows share is one row of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rnd
from ..session import MAX_BROADCAST_ROWS, materialize

BINS = 4096  # counts that one pass of an order statistic brings to the driver


def _ordered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows in range partitions of the order, with _part and _nth (place in it), read from files."""
    kept = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_mid", F.monotonically_increasing_id()), name)
    return kept.withColumns({"_part": F.shiftright("_mid", 33), "_nth": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_mid")


def _with_offsets(ordered: DataFrame, sums: dict[str, Column], name: str) -> DataFrame:
    """``ordered`` with, for each name, the sum over all partitions before the row's."""
    per = ordered.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    zero = F.lit(0).cast("long")
    offsets = materialize(per.select("_part", *[F.coalesce(F.sum(n).over(before), zero).alias(n) for n in sums]), name)
    small = offsets.count() <= MAX_BROADCAST_ROWS
    return ordered.join(F.broadcast(offsets) if small else offsets.hint("merge"), "_part")


def numbered(rows: DataFrame, order: list[Column], pos: str) -> DataFrame:
    """The rows with ``pos``, their place in the whole order, from 0."""
    placed = _with_offsets(_ordered(rows, order, "ranks-rows"), {"_before": F.lit(1)}, "ranks-offsets")
    return placed.withColumn(pos, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def dense_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): the distinct non-null values of a column as text, numbered from 0 in their (UTF-8) order."""
    values = df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, [F.col("value").asc()], "code")


def totals_below(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name, the sum over all rows before them in the order."""
    placed = _with_offsets(_ordered(rows, order, "ranks-rows"), sums, "ranks-offsets")
    inside = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return placed.withColumns({n: F.col(n) + F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()}).drop("_part", "_nth")


def average_ranks(df: DataFrame, score: str) -> DataFrame:
    """(score, n, rank): each distinct value with its rows and their average rank from 1."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    below = totals_below(per, [F.col("score").asc()], {"below": F.col("n")})
    return below.select("score", "n", (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC of unrounded scores (Mann-Whitney, ties half-credited), 4 decimals; 0 with one class.

    The products (2 x numerator) are DECIMAL(38,0): exact on billions of rows."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                                  F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    below = totals_below(per, [F.col("s").asc()], {"neg_below": F.col("neg")})
    return auc_of_counts(below)


def auc_of_counts(below: DataFrame) -> DataFrame:
    """AUC from (pos, neg, neg_below) of each distinct score."""
    wide = "decimal(19,0)"
    tot = below.agg(
        F.sum(F.col("pos").cast(wide) * (2 * F.col("neg_below") + F.col("neg")).cast(wide)).alias("num2"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    share = F.col("num2").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double"))
    return tot.select(F.when((F.col("P") > 0) & (F.col("N") > 0), rnd(share, 4)).otherwise(F.lit(0.0)).alias("auc"))


def order_statistics(values: DataFrame, col: str, ranks: list[int], bins: int = BINS) -> list[float]:
    """The values of the ranks (from 0) of a numeric column without nulls, all found in the same passes.

    Each pass counts the values in equal bins between two bounds and opens the bins that hold a rank: a bin's
    smallest and largest value are the next bounds. Bins follow the order of the values, whatever the rounding,
    and the two bounds never share a bin, so every pass narrows them until they are one value. Opened bins never
    overlap, so a value is counted in one of them at most, however many ranks there are."""
    x = F.col(col).cast("double")
    ends = values.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no values")
    at = {rank: (ends["lo"], ends["hi"], 0) for rank in ranks}  # bounds, and the values below them
    while wide := sorted({b for b in at.values() if b[0] < b[1]}):
        which = bin_ = None
        for i, (lo, hi, _) in enumerate(wide):
            inside, place = x.between(lo, hi), F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
            which = F.when(inside, F.lit(i)) if which is None else which.when(inside, F.lit(i))
            bin_ = F.when(inside, place) if bin_ is None else bin_.when(inside, place)
        counted = values.select(x.alias("x"), which.alias("which"), bin_.alias("bin")).where("which is not null").groupBy("which", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found: dict[int, list] = {i: [] for i in range(len(wide))}
        for r in sorted(counted.collect(), key=lambda r: (r["which"], r["bin"])):  # ``bins`` + 1 rows for each opened bin at most
            found[r["which"]].append(r)
        for rank, bounds in at.items():
            if bounds[0] < bounds[1]:
                skipped = bounds[2]
                for r in found[wide.index(bounds)]:
                    if skipped + r["n"] > rank:
                        at[rank] = (r["lo"], r["hi"], skipped)
                        break
                    skipped += r["n"]
    return [float(at[rank][0]) for rank in ranks]


def order_statistic(values: DataFrame, col: str, rank: int, bins: int = BINS) -> float:
    """The value of rank ``rank`` (from 0) of a numeric column without nulls."""
    return order_statistics(values, col, [rank], bins)[0]


def quantiles(values: DataFrame, col: str, shares: list[float], bins: int = BINS) -> list[float]:
    """The exact quantiles of the shares, linearly interpolated between neighbours. The values are read once in each
    pass: give a stored table where they are dear to derive."""
    n = values.count()
    places = [(math.floor(share * (n - 1)), share * (n - 1)) for share in shares]
    ranks = sorted({r for below, at in places for r in (below, min(below + 1, n - 1) if at > below else below)})
    value = dict(zip(ranks, order_statistics(values, col, ranks, bins)))
    out = []
    for below, at in places:
        a, t = value[below], at - below
        b = value[min(below + 1, n - 1)] if at > below else a
        out.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return out


def quantile(values: DataFrame, col: str, share: float, bins: int = BINS) -> float:
    """The exact ``share`` quantile, linearly interpolated between neighbours."""
    return quantiles(values, col, [share], bins)[0]
