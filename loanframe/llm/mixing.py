"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, each source gets a target and so a repetition
rate, and each document is emitted floor(rate) times plus one more time with
a probability equal to the rate's fraction, drawn from a hash of the seed and
the row.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; the
targets share the sum of all sizes, no target exceeds ``most`` times its
source's size, and what a full source leaves is shared again by weight.

Defined results: a null text has size 0; a source of size 0 has target 0 and
its documents are not emitted; null doc_ids draw by text alone; rows that are
equal draw alike; an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import WORD, lookup_join, stored
from loanframe.operators.ranks import numbered, totals_below

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (src, size) rows: one row per source with source_size, target and rate.

    A source is full when ``most * size / weight`` does not exceed the level
    that the others share; in the order of that ratio the full sources come
    first, so running totals give every level at once. Turns and totals are
    taken over range partitions, so sources may be as many as domains.
    """
    per = stored(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), "mix-sizes")
    per = numbered(per, [F.col("src").asc_nulls_last()], "turn")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    per = stored(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "mix-caps")
    ratio = F.col("cap").cast("double") / F.col("weight").cast("double")
    per = totals_below(per, [ratio.asc(), F.col("src").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")})
    everything = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = ((F.lit(float(everything["size"] or 0)) - F.col("caps").cast("double"))
             / (F.lit(float(everything["weight"] or 0)) - F.col("weights").cast("double")))
    per = stored(per.withColumn("level", level).withColumn("free", ratio > F.col("level")), "mix-levels")
    shared = per.agg(F.max(F.when(F.col("free"), F.col("level")))).first()[0]  # the first free source's level
    target = F.when(F.col("free"), F.least(F.lit(shared).cast("double") * F.col("weight").cast("double"), F.col("cap").cast("double"))
                    ).otherwise(F.col("cap").cast("double"))
    return per.select("src", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the row: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"),
                   F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row as struct ``r`` with size, source_size, target and copies."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"),
                       draw(F.col(id_col), F.col(text_col)).alias("draw"))
    plan = stored(targets(rows.select("src", "size")), "mix-targets").select(
        F.coalesce("src", F.lit("")).alias("k"), F.col("src").isNull().alias("no_src"), "source_size", "target", "rate")
    keyed = rows.withColumns({"k": F.coalesce("src", F.lit("")), "no_src": F.col("src").isNull()})
    out = lookup_join(keyed, plan, ["k", "no_src"])
    whole = F.floor("rate")
    return out.select("r", "size", "source_size", "target",
                      (whole + (F.col("draw") < F.col("rate") - whole).cast("long")).alias("copies"))


def mix(docs: DataFrame, **cols: str) -> DataFrame:
    """The mixed rows, repeats included, with the columns they came with."""
    some = rated(docs, **cols).where("copies > 0").select("r", F.col("copies").cast("int").alias("copies"))
    return some.select("r", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("r.*")
