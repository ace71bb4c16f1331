import re
from collections import Counter, defaultdict

import pytest

from loanframe.llm import mixing, quality_rules, url_filter
from loanframe.llm.oracle import ORACLE_SQL
from loanframe.llm.queries import QUERIES
from tests.oracle_check import compare, duck

from .helpers import SF, edge, edge_rows, empty

WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_matches(spark, name):
    ok, said = compare(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])
    assert ok, said


def base(t):
    words = re.findall(WORD, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_rules_base_figures_on_edges(spark):
    extra = ["a b c d e a b c d e a", "x y\nx y\n\nz", "a a a a a a", "| a | b | c | d | e |\nfine words end here, all ten of them are fine indeed."]
    df = edge(spark).select("doc_id", "text").unionByName(spark.createDataFrame(
        [(500 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = quality_rules.assess(df).collect()
    want = Counter((i, base(t)) for i, t in [(i, t) for i, t, _ in edge_rows()] + [(500 + i, t) for i, t in enumerate(extra)])
    got = Counter((r["r"]["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                                      r["base_failed"])) for r in rows)
    assert got == want
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_lines_fail_by_rule(spark):
    good = "This is a plain line of prose, with an end."
    bad = ["Home | About | Contact | Help", "buy$$$ now%%% cheap### pills***", "CLICK!! HERE!! NOW!!", "Menu",
           "All rights reserved.", "Accept all cookies to go on with this page."]
    more = "Another one follows it, in other words, and closes too."
    df = spark.createDataFrame([(good + "\n" + x + "\n" + more,) for x in bad] + [("\n".join(bad[:3]) + " a b c.",)], "text string")
    rows = quality_rules.assess(df).collect()
    assert all(r["cleaned"] == good + "\n" + more for r in rows[:-1])
    assert [r["kept"] for r in rows] == [r["lost_chars"] <= quality_rules.MAX_LOST * r["word_chars"] for r in rows]
    assert not rows[-1]["kept"]
    assert quality_rules.clean(edge(spark)).columns == edge(spark).columns
    assert quality_rules.assess(empty(spark)).collect() == []


def test_notices_in_each_language(spark):
    good = "Eine Zeile Text, die ganz ordentlich endet und lang genug ist."
    cases = [(f"Xx {x.upper()} yy zz.", lang) for lang, some in quality_rules.BOILERPLATE.items() for x in some]
    df = spark.createDataFrame([(good + "\n" + c,) for c, _ in cases], "text string")
    assert [r["cleaned"] for r in quality_rules.assess(df).collect()] == [good] * len(cases)
    other = quality_rules.assess(df, phrases={"en": quality_rules.BOILERPLATE["en"]}).collect()
    assert [r["cleaned"] == good for r in other] == [any(x in c.lower() for x in quality_rules.BOILERPLATE["en"]) for c, _ in cases]
    assert all(r["cleaned"].count("\n") for r in quality_rules.assess(df, phrases={}).collect())


def test_very_many_failing_lines(spark):
    """Lines are judged once each, so a text of a hundred thousand failing lines is no slower a line than a short one."""
    text = "\n".join(f"Menu {i}" if i % 2 else f"This is line {i} of the text, and it ends well." for i in range(100_000))
    r = quality_rules.assess(spark.createDataFrame([(text,)], "text string")).first()
    assert r["cleaned"] == "\n".join(text.split("\n")[::2]) and r["n_words"] == 650_000


def test_rules_of_a_table(spark):
    """Tens of thousands of rules; each URL runs the few that its tokens fetch."""
    many = [(f"||site{i}.example{i % 7}^", "block") for i in range(20_000)] + [("||site77.example0^", "allow"), ("/AdServer/*/x", "block"), ("", "block"), (None, "allow")]
    which = url_filter.rules_of(spark.createDataFrame(many + many[:50], "pattern string, verdict string"))
    assert len(which) == 20_002
    urls = {"http://a.SITE19.example5/b": "block", "http://site19.example4/": "allow", "http://site77.example0/": "allow",
            "http://q.com/adserver/1/X": "block", "http://q.com/adserver/1/y": "allow", None: "allow"}
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), which=which).collect()
    assert {r["r"]["url"]: r["verdict"] for r in got} == urls
    with pytest.raises(ValueError):
        url_filter.rules_of(spark.createDataFrame([("x", "maybe")], "pattern string, verdict string"))


def test_urls(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "https://b.example.net/en/7?x=/": ("b.example.net", "/en/7", "example.net/en/", "allow"),
        "https://example.net/EN/7": ("example.net", "/EN/7", "net/", "block"), "http://net": ("net", "", None, "allow"),
        "http://x.net?y=/": ("x.net", "", None, "allow"), "ftp://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://casino-win.example.com/en/1": ("casino-win.example.com", "/en/1", None, "block"),
        "http://spam-farm.example.org/fr/1": ("spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        "http://c.org/r?to=http://a.net/": ("c.org", "/r", None, "allow"), "nothing/net/": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://É.Org/fr/#a": ("É.org", "/fr/", "org/fr/", "allow"),
        "http://bücher.com/casino-win.": ("bücher.com", "/casino-win.", None, "allow"),
        "http://good.com/warez/x": ("good.com", "/warez/x", None, "block"), "http://ads.xxx": ("ads.xxx", "", None, "block"),
    }
    df = spark.createDataFrame([(u, "z", "z", "z") for u in cases] * 2, "url string, host string, rule string, tokens string")
    got = Counter((r["r"]["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect())
    assert got == Counter({(u, *x): 2 for u, x in cases.items()})
    assert url_filter.judge(df.limit(0)).collect() == []
    assert url_filter.allowed(df).columns == df.columns


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [url_filter.Rule("a", "block", False, "||common.rare^"), url_filter.Rule("b", "block", False, "*pre*")]
    urls = spark.createDataFrame([(["common", "x"],), (["common", "rare"],)], "tokens array<string>")
    assert {k: [r.name for r in v] for k, v in url_filter.index(urls, rules).items()} == {"rare": ["a"], "": ["b"]}


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        out = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if out[s] >= most * sizes[s]}
        if not over:
            return {**out, **{s: most * sizes[s] for s in full}}
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in full}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, None: 3, "é": 40}, {"x": 10}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 1000}])
def test_targets_by_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "src string, size long")
    got = {r["src"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_edges(spark):
    rows = mixing.rated(edge(spark)).collect()
    sizes = defaultdict(int)
    for _, t, s in edge_rows():
        sizes[s] += len(re.findall(WORD, t or ""))
    want = brute_targets(sizes)
    for r in rows:
        s = r["r"]["source"]
        assert r["size"] == len(re.findall(WORD, r["r"]["text"] or "")) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 3
    left = mixing.mix(edge(spark))
    assert left.columns == edge(spark).columns and left.count() == sum(r["copies"] for r in rows)
    assert Counter(map(str, left.collect())) == Counter(map(str, mixing.mix(edge(spark)).collect()))
    assert mixing.mix(empty(spark)).collect() == []
