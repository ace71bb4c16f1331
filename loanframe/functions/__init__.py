from .numeric import (WIDE, clip, exact_mean, exact_sum, hash_uniform, int_mean, rate_pct, rnd,
                      safe_div, trunc_long, wide_mean, wide_total)
from .text import inr_format, literal_map, lookup, parse_number, short_number, strip_ws
from .bands import badge, ew_bucket, grade_tier, risk_level, score_to_grade

__all__ = ["WIDE", "wide_mean", "wide_total", "clip", "exact_mean", "exact_sum", "hash_uniform", "int_mean", "rate_pct", "rnd",
           "safe_div", "trunc_long", "inr_format", "literal_map", "lookup", "parse_number", "short_number",
           "strip_ws", "badge", "ew_bucket", "grade_tier", "risk_level", "score_to_grade"]
