"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a filter pattern: ``||`` anchors it at the host or any of its parent
domains, ``^`` is a separator or the end, ``*`` is anything; letters fit in either
case.  Rules come as lists or as a table.  Each rule is filed
under the one of its literal tokens that is rarest in the URLs at hand (counted
by Spark).  A URL's own tokens fetch its candidate rules from that index, and
only candidates run as regular expressions.  The index is a constant of the
plan, so nothing is shuffled but the token counts.

Site rules (host and path prefix, ``net/``) decide first, the longest wins; a URL
that none fits is blocked if a block pattern fits and no exception does.

Defined results: a null URL or one without ``://`` has an empty host and path and
is allowed unless a pattern without a token fits it; repeated rows are judged
alike; an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000  # the index is part of the plan: rule lists are bounded
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path, verdict)
SITE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
              ("org", "/fr/", "allow"))

BLOCK_PATTERNS = (
    "||ads-track.", "||adult-x.", "||casino-win.", "||cheap-pills.", "||free-bets.", "||spam-farm.",
    "||doubleclick.net^", "||googlesyndication.com^", "||adservice.*^", "||popads.net^", "||adnxs.com^",
    "||bet365.*^", "||xvideos.*^", "||pornhub.*^", "||viagra*^", "-online-casino.", ".casino^", ".porn^", ".xxx^",
    "/adserver/", "/ad-banner/", "/doorway/", "/phishing/", "/malware/", "/warez/",
)
ALLOW_PATTERNS = ("||en.wikipedia.org^", "||archive.org^")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    site: bool
    pattern: str

    @property
    def regex(self) -> str:
        body = self.pattern.removeprefix("||")
        parts = [{"^": "(?:[^A-Za-z0-9_.%-]|$)", "*": ".*"}.get(x) or re.sub(r"([^A-Za-z0-9_/])", r"\\\1", x)
                 for x in re.split(r"([\^*])", body) if x]
        return ("(?s)" if self.site else "(?si)") + ("^(?:[^/?#]*\\.)?" if self.pattern.startswith("||") else "") + "".join(parts)

    @property
    def tokens(self) -> list[str]:
        """Literal runs that are whole tokens of every URL that the rule fits."""
        body, out = self.pattern.removeprefix("||"), []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = body[m.start() - 1] if m.start() else ("|" if self.pattern.startswith("||") else "*")
            right = body[m.end()] if m.end() < len(body) else "*"
            if "*" not in (left, right):
                out.append(m[0].lower())
        return out


def rules(sites: Sequence[tuple[str, str, str]] = SITE_RULES, block: Sequence[str] = BLOCK_PATTERNS,
          allow: Sequence[str] = ALLOW_PATTERNS) -> list[Rule]:
    out = [Rule(h + p, v, True, f"||{h}{p}") for h, p, v in sites]
    out += [Rule(p, "block", False, p) for p in block] + [Rule(p, "allow", False, p) for p in allow]
    if len(out) > MAX_RULES:
        raise ValueError(f"{len(out)} rules; at most {MAX_RULES}")
    return out


def rules_of(table: DataFrame, sites: Sequence[tuple[str, str, str]] = ()) -> list[Rule]:
    """Rules of a table (pattern, verdict: block or allow), with site rules; null or empty patterns are left out.

    The driver reads at most MAX_RULES + 1 rows."""
    some = table.select(F.col("pattern").cast("string"), F.col("verdict").cast("string")).where("length(pattern) > 0").distinct()
    rows = sorted(tuple(r) for r in some.limit(MAX_RULES + 1).collect())
    if odd := {v for _, v in rows} - {"block", "allow"}:
        raise ValueError(f"verdicts {sorted(map(str, odd))}")
    return rules(sites, [p for p, v in rows if v == "block"], [p for p, v in rows if v == "allow"])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _after_host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*(.*)$", 1)


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def index(urls: DataFrame, which: list[Rule]) -> dict[str, list[Rule]]:
    """Token -> rules filed under it; ``urls`` has a column ``tokens``. Key '' holds rules without a token."""
    known = sorted({t for r in which for t in r.tokens})
    seen = F.explode(F.filter("tokens", lambda t: t.isin(known))).alias("token")
    count = dict(urls.select(seen).groupBy("token").count().collect()) if known else {}  # a row per known token
    out: dict[str, list[Rule]] = {}
    for r in which:
        out.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t), default=""), []).append(r)
    return out


def judge(pages: DataFrame, url_col: str = "url", which: list[Rule] | None = None) -> DataFrame:
    """Each row as struct ``r`` with host, path, rule and verdict."""
    which = rules() if which is None else which
    url = F.col(url_col).cast("string")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("r"), host_of(url).alias("host"),
                        path_of(url).alias("path"), F.concat(host_of(url), _after_host(url)).alias("target"))
    rows = rows.withColumn("tokens", _tokens(F.col("target")))
    filed = {t: [{"name": r.name, "verdict": r.verdict, "site": r.site, "regex": r.regex} for r in rs]
             for t, rs in index(rows, which).items()}
    kind = "map<string,array<struct<name:string,verdict:string,site:boolean,regex:string>>>"
    book = F.from_json(F.lit(json.dumps(filed)), kind)  # folded to a constant
    fetch = F.flatten(F.filter(F.transform(F.array_union("tokens", F.array(F.lit(""))), lambda t: F.try_element_at(book, t)),
                               lambda c: c.isNotNull()))
    fits = rows.withColumn("fetched", fetch).withColumn(
        "fits", F.filter("fetched", lambda c: F.regexp_like("target", c["regex"])))
    longest = F.reduce(F.filter("fits", lambda c: c["site"]), F.lit(None).cast(
        "struct<name:string,verdict:string,site:boolean,regex:string>"),
        lambda best, c: F.when(best.isNull() | (F.length(c["name"]) > F.length(best["name"])), c).otherwise(best))
    out = fits.withColumn("best", longest)
    has = lambda verdict: F.exists("fits", lambda c: c["verdict"] == verdict)
    return out.select("r", "host", "path", F.col("best.name").alias("rule"),
                      F.coalesce(F.col("best.verdict"),
                                 F.when(has("block") & ~has("allow"), F.lit("block")).otherwise(F.lit("allow"))
                                 ).alias("verdict"))


def allowed(pages: DataFrame, url_col: str = "url", which: list[Rule] | None = None) -> DataFrame:
    """The rows whose URL is allowed, with the columns they came with."""
    return judge(pages, url_col, which).where("verdict = 'allow'").select("r.*")
