"""String helpers: whitespace strip, literal lookup maps, numeric parsing,
money formatting. All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# Python's str.strip() removes all leading/trailing whitespace, SQL trim only
# spaces: trim with an explicit character set instead.

# A plain decimal / scientific number, or an infinity. Applied to a
# lower-cased, stripped string before try_cast so that Spark-only literal
# forms such as '5d' or '5f' are not accepted.
NUMERIC_RE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"


# The characters that Python calls white space.
_WS_CHARS = (" \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
             "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace like Python's str.strip(), the Unicode
    spaces included; a character-set trim, no regex."""
    return F.btrim(col_(c), F.lit(_WS_CHARS))


def literal_map(mapping: dict) -> Column:
    """A MAP literal built from a small fixed dict (folded by Catalyst)."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(mapping: dict, key) -> Column:
    """mapping[key] or NULL."""
    return F.try_element_at(literal_map(mapping), col_(key))


def parse_number(c) -> Column:
    """pandas ``to_numeric(errors='coerce')`` for one string: NULL unless the
    stripped text is a number."""
    s = F.lower(strip_ws(col_(c).cast("string")))
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def _idiv(num: Column, den: int) -> Column:
    """Exact floor division of a non-negative BIGINT by a positive constant."""
    return ((num - num % F.lit(den)) / F.lit(den)).cast("long")


def _tenths(units: Column, divisor: int) -> Column:
    """round-half-away(units / divisor, 1) as text, with integer arithmetic."""
    t = _idiv(units + F.lit(divisor // 20), divisor // 10)
    return F.concat(_idiv(t, 10).cast("string"), F.lit("."), (t % F.lit(10)).cast("string"))


def inr_format(c) -> Column:
    """Indian-rupee short money text as shown on the dashboard:
    >= 1e7 -> 'x.yCr', >= 1e5 -> 'x.yL', else 'xK' (ties away from zero).

    Negative amounts never reach the Cr/L branches (the thresholds compare the
    signed value), exactly like the dashboard formatter. Evaluated with
    integer arithmetic on whole rupees so every engine prints the same
    digits; non-integral input is first rounded to whole rupees.
    """
    v = F.rint(col_(c).cast("double"))
    units = F.abs(v).cast("long")
    thousands = _idiv(units + F.lit(500), 1000).cast("string")
    body = (F.when(v >= F.lit(1e7), F.concat(_tenths(units, 10_000_000), F.lit("Cr")))
            .when(v >= F.lit(1e5), F.concat(_tenths(units, 100_000), F.lit("L")))
            .when(v < F.lit(0.0), F.concat(F.lit("-"), thousands, F.lit("K")))
            .otherwise(F.concat(thousands, F.lit("K"))))
    return F.concat(F.lit("₹"), body)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_fixed(x: Column, digits: int) -> Column:
    """A non-negative double with 0 or 1 decimals as text, rounded half up on its exact binary value.

    n is the whole part of x (or of 10 x, taken apart as 8 x + 2 x); what is left beside n + 1/2 is
    exact in double arithmetic, so its sign decides the rounding without a decimal type."""
    def text(n: Column) -> Column:
        half = n.cast("double") + F.lit(0.5)
        rest = x - half if digits == 0 else (x * F.lit(8.0) - half) + x * F.lit(2.0)
        up = n + F.when(rest >= F.lit(0.0), F.lit(1)).otherwise(F.lit(0))
        if digits == 0:
            return up.cast("string")
        return _let(up, lambda t: F.concat(_idiv(t, 10).cast("string"), F.lit("."), (t % F.lit(10)).cast("string")))

    return _let(F.floor(x if digits == 0 else x * F.lit(10.0)), text)


def short_number(c) -> Column:
    """Chart axis text: x.yCr from 1e7, x.yL from 1e5, xK from 1e3 (by absolute value), else x.y; missing -> '0'."""
    v = col_(c).cast("double")
    a = F.abs(v)
    unit = F.when(a >= F.lit(1e7), F.lit(1e7)).when(a >= F.lit(1e5), F.lit(1e5)).when(a >= F.lit(1e3), F.lit(1e3)).otherwise(F.lit(1.0))
    body = _let(F.struct((a / unit).alias("q"), unit.alias("unit")), lambda s: F.concat(
        F.when(s["unit"] == F.lit(1e3), to_fixed(s["q"], 0)).otherwise(to_fixed(s["q"], 1)),
        F.when(s["unit"] == F.lit(1e7), "Cr").when(s["unit"] == F.lit(1e5), "L").when(s["unit"] == F.lit(1e3), "K").otherwise("")))
    signed = F.when(v < F.lit(0.0), F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(v.isNull() | F.isnan(v), F.lit("0")).otherwise(signed)
