"""Normalisation of an uploaded loan table onto the canonical schema.

The pipeline is a chain of projections (``DataFrame.transform``), so the whole
normaliser runs inside the scan's tasks with no shuffle; only loan-id
assignment for files without ids (N14) writes the rows once and counts them.

Steps run in this order, because later steps read earlier results:
headers -> aliases -> grade -> grade from score -> categories -> default
flag -> delinquency -> status -> numeric coercion -> string defaults ->
loan id -> cohort -> value proxy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import lookup, parse_number, rnd, score_to_grade, strip_ws, trunc_long
from ..session import MAX_BROADCAST_ROWS, materialize

CANONICAL = ["loan_id", "geography", "employment_type", "credit_score", "income_proxy", "credit_quality",
             "product_type", "loan_size", "tenure_months", "pricing_rate", "ltv_ratio", "dti_ratio",
             "delinquency_status", "loan_status", "cashflow_consistency", "balance_volatility", "spending_shock",
             "acquisition_channel", "origination_month", "cohort", "default_indicator", "value_proxy"]

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def canonical_header(name: str) -> str:
    """Strip, lower-case, spaces and dashes to underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def canonical_headers(df: DataFrame) -> DataFrame:
    """N1 + N2: canonical header names, then alias renames.

    Several source columns that land on the same target (two aliases, or an
    alias next to the canonical name) are merged with ``coalesce`` in file
    order instead of producing duplicate columns.
    """
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(df.columns):
        target = canonical_header(name)
        target = K.COLUMN_ALIASES.get(target, target)
        groups.setdefault(target, []).append(i)
    cols = []
    for target, idx in groups.items():
        srcs = [F.col(f"_c{i}") for i in idx]
        types = {positional.schema[f"_c{i}"].dataType.simpleString() for i in idx}
        if len(types) > 1:
            srcs = [c.cast("string") for c in srcs]
        cols.append((srcs[0] if len(srcs) == 1 else F.coalesce(*srcs)).alias(target))
    return positional.select(*cols)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def normalize_grade(df: DataFrame) -> DataFrame:
    """Trim + lower, alias map; anything unknown becomes NULL."""
    if "credit_quality" not in df.columns:
        return df
    s = F.lower(strip_ws(_text("credit_quality")))
    up = F.upper(s)
    return df.withColumn("credit_quality", F.coalesce(lookup(K.GRADE_ALIASES, s), F.when(up.isin(K.GRADES), up)))


def _number(df: DataFrame, c: str) -> Column:
    """pandas to_numeric(errors='coerce') on any input type."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.BooleanType):
        return F.col(c).cast("double")
    if isinstance(dt, _NUMERIC_TYPES):
        d = F.col(c).cast("double")
        return F.when(~F.isnan(d), d)
    return parse_number(F.col(c))


def fill_grade_from_score(df: DataFrame) -> DataFrame:
    """Missing grades from the credit score (before numeric defaults, so a
    missing or unparseable score gives CCC); with no score column, BBB."""
    if "credit_score" in df.columns:
        derived = score_to_grade(_number(df, "credit_score"))
    else:
        derived = F.lit("BBB")
    if "credit_quality" in df.columns:
        return df.withColumn("credit_quality", F.coalesce(F.col("credit_quality"), derived))
    return df.withColumn("credit_quality", derived)


def _category(df: DataFrame, c: str, aliases: dict) -> DataFrame:
    if c not in df.columns:
        return df
    s = strip_ws(_text(c))
    return df.withColumn(c, F.coalesce(lookup(aliases, F.lower(s)), s))


def normalize_employment(df: DataFrame) -> DataFrame:
    """N5."""
    return _category(df, "employment_type", K.EMPLOYMENT_ALIASES)


def normalize_product(df: DataFrame) -> DataFrame:
    """N6."""
    return _category(df, "product_type", K.PRODUCT_ALIASES)


def normalize_geography(df: DataFrame) -> DataFrame:
    """N7."""
    return _category(df, "geography", K.GEOGRAPHY_ALIASES)


def normalize_channel(df: DataFrame) -> DataFrame:
    """N8."""
    return _category(df, "acquisition_channel", K.CHANNEL_ALIASES)


def parse_default_flag(df: DataFrame) -> DataFrame:
    """yes/true/1/default/... -> 1, anything else 0; a numeric 1 (e.g.
    '1.0') also counts. Absent column -> 0."""
    if "default_indicator" not in df.columns:
        return df.withColumn("default_indicator", F.lit(0))
    s = F.lower(strip_ws(_text("default_indicator")))
    flag = s.isin(K.DEFAULT_FLAG_TRUE) | (_number(df, "default_indicator") == 1)
    return df.withColumn("default_indicator", F.coalesce(flag, F.lit(False)).cast("int"))


def parse_delinquency(df: DataFrame) -> DataFrame:
    """First matching rule wins: defaulted -> Default; a delinquency marker
    -> DPD30+; 'current', '0' or missing -> Current; a positive number ->
    DPD30+; anything else Current."""
    is_def = F.col("default_indicator") == 1
    if "delinquency_status" not in df.columns:
        return df.withColumn("delinquency_status", F.when(is_def, "Default").otherwise("Current"))
    raw = F.lower(strip_ws(_text("delinquency_status")))
    marker = None
    for m in K.DELINQUENT_MARKERS:
        hit = raw.contains(m)
        marker = hit if marker is None else (marker | hit)
    current = raw.isNull() | raw.contains("current") | (raw == "0") | (raw == "nan")
    return df.withColumn(
        "delinquency_status",
        F.when(is_def, "Default").when(marker, "DPD30+").when(current, "Current")
        .when(parse_number(raw) > 0, "DPD30+").otherwise("Current"))


def derive_loan_status(df: DataFrame) -> DataFrame:
    """Default / At-Risk (DPD30+) / Active; replaces any uploaded status."""
    return df.withColumn(
        "loan_status",
        F.when(F.col("default_indicator") == 1, "Default")
        .when(F.col("delinquency_status") == "DPD30+", "At-Risk").otherwise("Active"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """to_numeric with coercion, then the fixed default for anything
    missing or unparseable; 'true'/'false' count as 1/0 for the shock flag."""
    out = {}
    for c, d in K.NUMERIC_DEFAULTS.items():
        if c not in df.columns:
            out[c] = F.lit(float(d))
            continue
        v = _number(df, c)
        if c == "spending_shock" and not isinstance(df.schema[c].dataType, _NUMERIC_TYPES):
            b = F.lower(strip_ws(_text(c)))
            v = F.when(b == "true", F.lit(1.0)).when(b == "false", F.lit(0.0)).otherwise(v)
        out[c] = F.coalesce(v, F.lit(float(d)))
    return df.withColumns(out)


def fill_strings(df: DataFrame) -> DataFrame:
    """Fixed defaults for missing text, trimmed."""
    return df.withColumns({
        c: (F.coalesce(strip_ws(_text(c)), F.lit(d)) if c in df.columns else F.lit(d))
        for c, d in K.STRING_DEFAULTS.items()})


def assign_loan_ids(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """``LN-%06d`` by 1-based row position when the table has no loan_id.

    With ``order_col`` the position is the rank in that column's order (a
    distributed sort); without it, the position is the scan order.

    The rows are tagged with their partition and their place in it and written
    once to the shared folder. Partition sizes and the final numbers are both
    read from those files, so no later plan change (other columns kept, other
    AQE partition sizes, another join) can number one layout with the counts
    of another. The table of partition sizes is broadcast only while its
    counted rows stay small; beyond that it is an ordinary join.
    """
    if "loan_id" in df.columns:
        return df
    src = df.orderBy(order_col) if order_col else df
    # monotonically_increasing_id = (partition index << 33) + row in partition
    rows = materialize(src.withColumn("_mid", F.monotonically_increasing_id()), "loan-positions")
    part = F.shiftright(F.col("_mid"), 33)
    counts = rows.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")  # one row per partition
    offsets = materialize(counts.select("_pid", before.alias("_off")), "loan-offsets")
    small = offsets.count() <= MAX_BROADCAST_ROWS
    with_off = rows.withColumn("_pid", part).join(F.broadcast(offsets) if small else offsets, "_pid")
    pos = F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return with_off.withColumn("loan_id", F.format_string("LN-%06d", pos)).drop("_pid", "_mid", "_off")


def cohort_bucket(df: DataFrame) -> DataFrame:
    """6-month vintage C1, C2, ... from the origination month, if absent."""
    if "cohort" in df.columns:
        return df
    m = trunc_long(F.col("origination_month"))
    return df.withColumn("cohort", F.concat(F.lit("C"), (F.floor(m / F.lit(6.0)) + 1).cast("string")))


def value_proxy(df: DataFrame) -> DataFrame:
    """R(size * rate / 100 * (-0.4 if defaulted else 0.8), 2), if absent."""
    if "value_proxy" in df.columns:
        return df
    factor = F.when(F.col("default_indicator") == 1, F.lit(-0.4)).otherwise(F.lit(0.8))
    return df.withColumn("value_proxy", rnd(F.col("loan_size") * F.col("pricing_rate") / 100 * factor, 2))


def derive_ratios(df: DataFrame) -> DataFrame:
    """ltv = clip(R(size / (income * 12 * 0.4), 3), 0, 3);
    dti = clip(R(size / tenure / income, 4), 0, 0.8)."""
    size = F.col("loan_size").cast("double")
    ltv = rnd(size / (F.col("income_proxy") * 12 * F.lit(0.4)), 3)
    dti = rnd(size / F.col("tenure_months") / F.col("income_proxy"), 4)
    return df.withColumns({"ltv_ratio": F.least(F.greatest(ltv, F.lit(0.0)), F.lit(3.0)),
                           "dti_ratio": F.least(F.greatest(dti, F.lit(0.0)), F.lit(0.8))})


STEPS = [
    ("normalize_headers", canonical_headers),
    ("normalize_grade", normalize_grade),
    ("grade_from_score", fill_grade_from_score),
    ("normalize_employment", normalize_employment),
    ("normalize_product", normalize_product),
    ("normalize_geography", normalize_geography),
    ("normalize_channel", normalize_channel),
    ("parse_default_flag", parse_default_flag),
    ("parse_delinquency", parse_delinquency),
    ("loan_status", derive_loan_status),
    ("coerce_numeric", coerce_numeric),
    ("fill_strings", fill_strings),
    ("assign_loan_ids", assign_loan_ids),
    ("cohort_bucket", cohort_bucket),
    ("value_proxy", value_proxy),
]


def normalize_until(raw: DataFrame, last: str) -> DataFrame:
    """Run the pipeline up to and including step ``last``."""
    df = raw
    for name, fn in STEPS:
        df = df.transform(fn)
        if name == last:
            return df
    raise KeyError(last)


def normalize_loans(raw: DataFrame) -> DataFrame:
    """The whole pipeline; canonical columns first, extra uploaded
    columns kept after them."""
    df = raw
    for _, fn in STEPS:
        df = df.transform(fn)
    extra = [c for c in df.columns if c not in CANONICAL]
    return df.select(*CANONICAL, *extra)

