"""Line-first quality cleaning, in DataFrame operations only.

Every line is judged first: punctuation rules (symbol-laden lines, shouted
lines), navigation rules (bar-separated links, bare menu words) and boilerplate
rules (licence, cookie, script notices).  Failing lines are removed, and a
document that loses more than ``MAX_LOST`` of its word characters is rejected,
as is one that fails the base rules (too few words, too much repetition).

All per-document work stays inside one row: five-word windows are hashed and
compared within their array, so nothing is shuffled.

Defined results: a null text has no words and fails the base rules; an empty
table gives no rows; repeated rows are judged alike; other columns, whatever
their names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import WORD

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
BAR = "[|\\u00bb\\u203a\\u2022]"
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
MAX_LOST = 0.45  # share of word characters that a kept document may lose

# Line rules: a line of n words fails when it has more than
MAX_SYMBOLS = 0.4  # symbols a word
MAX_SHOUTS = 0.3  # doubled exclamation or question marks a word
MIN_BARS, MAX_BARS = 2, 0.2  # separators, and separators a word
MENU_WORDS = 2  # or has at most so many words and no closing mark
CLOSED = "[.!?:;\"')\\]\\u2026\\u201d\\u3002]\\s*$"
# Notices (lower case) that make a line boilerplate, by language; a line is looked through for all of them.
BOILERPLATE = {
    "en": ("all rights reserved", "licensed under", "is licensed", "cookie policy", "accept cookies", "accept all cookies",
           "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum",
           "subscribe to our newsletter", "click here to"),
    "de": ("alle rechte vorbehalten", "lizenziert unter", "cookie-richtlinie", "cookies akzeptieren", "datenschutzerklärung",
           "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren", "hier klicken"),
    "fr": ("tous droits réservés", "sous licence", "politique de cookies", "accepter les cookies", "accepter tous les cookies",
           "politique de confidentialité", "conditions d'utilisation", "activer javascript", "abonnez-vous à notre", "cliquez ici"),
    "es": ("todos los derechos reservados", "bajo licencia", "política de cookies", "aceptar cookies", "aceptar todas las cookies",
           "política de privacidad", "términos de uso", "condiciones de uso", "habilitar javascript", "suscríbete a nuestro",
           "haz clic aquí"),
}


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def failing_line(line: Column, phrases: Mapping[str, Sequence[str]] = BOILERPLATE) -> Column:
    """Words are counted last: only a line with marks, or one without an end, needs them."""
    n, symbols, shouts, bars = (_count(line, x) for x in (WORD, SYMBOL, "[!?]{2}", BAR))
    marked = line.rlike(SYMBOL + "|[!?]{2}|" + BAR) & (
        (symbols > n * MAX_SYMBOLS) | (shouts > n * MAX_SHOUTS) | ((bars >= MIN_BARS) & (bars > n * MAX_BARS)))
    menu = ~line.rlike(CLOSED) & n.between(1, MENU_WORDS)
    low = F.lower(line)
    return marked | menu | reduce(or_, [low.contains(x) for some in phrases.values() for x in some], F.lit(False))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more in the array, the first find included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(order: Column) -> Column:
        # Equal hashes are neighbours in sorted order; their places, sorted again, give the covered words.
        same = lambda x, i: ((i > 0) & (F.get(order, i - 1)["h"] == x["h"])) | F.coalesce(
            F.get(order, i + 1)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(order, same), lambda x: x["i"]))
        return _let(places, lambda p: F.reduce(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))

    def counted(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(order, covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, counted))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def assess(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, Sequence[str]] = BOILERPLATE) -> DataFrame:
    """Each row as struct ``r`` with the base figures, the cleaned text and the verdict."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumns({"words": F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE + "+")), "lines": F.split("t", "\n")})
    # Each line is judged once and carries its verdict.
    rows = rows.withColumn("judged", F.transform("lines", lambda x: F.struct(x.alias("line"), failing_line(x, phrases).alias("bad"))))
    rows = rows.withColumn("failing", F.transform(F.filter("judged", lambda j: j["bad"]), lambda j: j["line"]))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _count(F.col("t"), SYMBOL).cast("long"),
        "full": F.filter("lines", lambda x: x.rlike(WORD)),
        "n_repeat_words": repeat_words(F.col("words")).cast("long"),
        "lost": F.reduce("failing", F.lit(0), lambda n, x: n + F.length(x) - _count(x, SPACE)),
        "cleaned": F.when(F.size("failing") == 0, F.col("t")).otherwise(
            F.array_join(F.transform(F.filter("judged", lambda j: ~j["bad"]), lambda j: j["line"]), "\n")),
    })
    lost = F.col("lost")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return rows.select("r", "n_words", "word_chars", "n_symbols",
                       (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
                       "n_repeat_words", base_failed.alias("base_failed"), "cleaned", lost.cast("long").alias("lost_chars"),
                       (~base_failed & (lost <= F.col("word_chars") * MAX_LOST)).alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, Sequence[str]] = BOILERPLATE) -> DataFrame:
    """The kept rows with their failing lines removed, in the columns they came with."""
    cols = [F.col("cleaned").alias(c) if c == text_col else F.col(f"r.`{c}`") for c in docs.columns]
    return assess(docs, text_col, phrases).where("kept").select(*cols)
