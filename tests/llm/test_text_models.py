import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from loanframe.llm import html_text, quality_classifier
from loanframe.llm.html_text import main_text

from .helpers import CLASHES, edge, edge_rows, empty

MID = "/root/testdata/sf0.01"


def test_main_text_of_the_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, many of them, on every page that you read here.</div>
    <aside><p>Side bar, with a long text, and commas, that nobody needs, at all, in any way.</p></aside>
    <article><header><h1>The &amp; title</h1></header><p><b>First   para</b>graph,
    with a line.<br>Next<p>Second one &lt;here&gt;, &#233;.<ul><li>point one<li>point two</ul>
    <form><p>Sign up, please, now.</p><input name=x></form>
    <section id="comments"><p>A comment, which is long, longer than the text, and has commas, commas, commas, and more.</p></section>
    </article><footer>&copy; foot</footer></body></html>"""
    assert main_text(page) == ("The & title First paragraph, with a line. Next Second one <here>, é. point one point two")


def test_main_text_without_an_article():
    page = """<body><div id="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="content"><h2>Head</h2>
    <p>Some text here, of a fair length, so that it counts.</p><p>More of it, and more.</p></div>
    <div class="links"><a href=1>a link that is long</a><a href=2>and another long link</a></div></body>"""
    assert main_text(page) == "Head Some text here, of a fair length, so that it counts. More of it, and more."
    assert main_text("just <i>te</i>xt") == "just text"
    assert main_text(None) == main_text("") == main_text("<html><script>x") == ""
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("<p>" + "<b>" * 5000 + "deep, down") == "deep, down"
    assert main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep er"


LONG = "".join(f"<p>Paragraph {i}, which is long, says this and that, and goes on for a good while without end.</p>" for i in range(20))
PARTS = ("<section><p>One short line.</p></section><h5>Small head</h5><section>%s</section><ul><li>point one<li>point two</ul>"
         "<dl><dt>term<dd>meaning</dl><figure><figcaption>Caption</figcaption></figure><blockquote>Bare quote</blockquote>"
         "<table><tbody><tr><td>cell</td></tr></tbody></table><pre>a = b</pre>" % LONG)


def plain_text(page):
    import re

    return " ".join(re.sub(r"<[^>]*>", " ", page).split())


def test_all_parts_of_the_article_are_kept():
    rest = "<div class=x><a href=1>a link</a> <a href=2>other</a></div>"
    for tag in ("article", "main", "div", "div><div"):
        end = tag.replace("<", "</")
        assert main_text(f"<body><{tag}>{PARTS}</{end}>{rest}</body>") == plain_text(PARTS), tag
    assert main_text(f"<article>{PARTS}<section><p>{LONG}</section></article>") == plain_text(PARTS + LONG)
    assert main_text(f"<main><article>{PARTS}</article><article><p>Other</p></article></main>") == plain_text(PARTS)
    bare = "A bare line, long enough, with commas, stands before the others"
    assert main_text(f"<div>{bare}<div>{LONG}</div>{rest}</div>") == plain_text(f"{bare} {LONG}")


def test_an_unclosed_head_or_skipped_element_does_not_hide_the_page():
    text = plain_text(LONG)
    assert main_text(f"<html><head><title>T</title><meta charset=utf-8><body><article>{LONG}</article></body></html>") == text
    assert main_text(f"<html><head><title>T</title><article>{LONG}</article>") == text
    assert main_text(f"<head><title>T<body>{LONG}") == main_text(f"<head><noscript><img src=x><body>{LONG}") == text
    assert main_text("<head><title>T</title>bare text") == "bare text"
    for tag in ("button", "noscript", "canvas", "svg", "object", "select"):
        for page in (f"<body><div><{tag}>Menu</div><article>{LONG}</article></body>", f"<body><{tag}>Menu<article>{LONG}</article></body>",
                     f"<article><p>{LONG}<{tag}><b>x{LONG}</article>"):
            assert main_text(page) == (text if "<b>" not in page else f"{text} {text}"), page[:60]
        shut = f"<article>{LONG}<div><{tag}><span>Menu</span></{tag}></div><p>End <{tag}>x</{tag}>of it</article>"
        assert main_text(shut) == text + " End of it"
    assert main_text("<article><p>a <button><div>x</div></button>b<p>c</article>") == "a b c"
    assert main_text("<p>a <svg viewBox=x><title>t</title><g><path d=M /></g></svg>b</p>") == "a b"


def test_names_do_not_cut_the_article():
    text = plain_text(LONG)
    for name in ("content has-sidebar", "no-sidebar", "with-comments", "widget post-body", "comments-open page"):
        assert main_text(f'<div class="{name}"><article>{LONG}</article></div><p>&copy; me') == text, name
        assert main_text(f'<body><div class="{name}">{LONG}</div></body>') == text, name
        assert main_text(f'<main><div id=x class="{name}">{LONG}</div></main>') == text, name
    assert main_text(f"<body><form id=aspnetForm><main>{LONG}</main></form></body>") == text
    assert main_text(f"<body><nav>Menu<article>{LONG}</article></body>") == text
    assert main_text('<article><pre>a <span class="hljs-comment"># b</span></pre></article>') == "a # b"
    # Comments, adverts and notices stay cut, however long, where an article stands beside or around them.
    for name in ("comments", "comment-list", "replies"):
        assert main_text(f"<div class=post><p>Short post.</p></div><div id={name}><article>{LONG}</article></div>") == "Short post."
        assert main_text(f"<article><p>Short post.</p><section id={name}>{LONG}</section></article>") == "Short post."
    assert main_text(f"<article><p>Short post.</p></article><div class=cookie-consent>{LONG}</div>") == "Short post."
    assert main_text(f"<article>{LONG}<div class=ad><p>Buy</p></div></article>") == text


def test_pages_of_the_table(spark):
    import html
    import re

    rows = pq.read_table(f"{MID}/pages.parquet").to_pylist()
    got = {r["r"]["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{MID}/pages.parquet")).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "", "t"), (None, "<p>a</p>", "t"), (None, "<p>a</p>", "t")], "page_id long, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "a", "a"] and all(r["r"]["text"] == "t" for r in rows)
    assert html_text.extract(df.limit(0)).collect() == []


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    c = quality_classifier
    model = c.fit(docs, labels)
    got = {r["r"]["doc_id"]: r["score"] for r in c.score(docs.select("doc_id", "text"), model).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    good = [got[i] for i, q in known.items() if q == 1]
    bad = [got[i] for i, q in known.items() if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8
    again = c.fit(docs, labels)
    assert (again.values == model.values).all() and again.bias == model.bias
    # A score is the softmax over the averaged features, computed plainly.
    for text in ("And the the Thing, x", "été  Été\n日本", "a"):
        plain = 1 / (1 + np.exp(-(model.values[plain_buckets(text)].mean() + model.bias)))
        assert np.allclose(model.scores(pa.array(["x y", text, None])), [model.scores(pa.array(["x y"]))[0], plain, 1 / (1 + np.exp(-model.bias))])


def plain_buckets(text):
    """Buckets of a text's features, one at a time in Python integers."""
    c, full = quality_classifier, (1 << 64) - 1
    base, top = int(c._BASE), 64 - (c.BUCKETS - 1).bit_length()

    def mix(x, kind):
        x = (x + kind * 0xD6E8FEB86659FD93 + 1) & full
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    words, whole, out = text.split(), [], []
    for w in words:
        marked = f"<{w}>"
        whole.append(mix(sum(ord(x) * pow(base, i, 1 << 64) for i, x in enumerate(marked)) & full, 0))
        out.append(whole[-1])
        for n in c.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 0
                for x in marked[i:i + n]:
                    h = (h * base + ord(x)) & full
                out.append(mix(h, n))
    pairs = [mix(a ^ b, 11) for a, b in zip(whole, whole[1:])]
    out += pairs + [mix((a * base + b) & full, 12) for a, b in zip(pairs, pairs[1:])]
    return [h >> top for h in out]


def test_slices_do_not_change_the_scores(monkeypatch):
    rng = np.random.default_rng(2)
    c = quality_classifier
    model = c.Model(rng.normal(size=c.BUCKETS), 0.1)
    some = pa.array([" ".join(rng.choice(["ab", "cde", "é", "ab"], rng.integers(0, 60))) for _ in range(50)] + [None, "", "x " * 5000])
    want = model.scores(some)
    monkeypatch.setattr(c, "SLICE_BYTES", 100)
    assert np.allclose(model.scores(some), want) and len(model.scores(some[:0])) == 0


def test_labels_and_ids_do_not_reach_the_score(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    c = quality_classifier
    model = c.fit(docs, labels)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert (c.fit(docs, flipped).values == model.values).all()


def test_classifier_edges(spark):
    c = quality_classifier
    labels = spark.createDataFrame([(1, 1, "a"), (4, 0, "b"), (4, 1, "c"), (5, 0, None), (None, 1, "d"), (9, None, "e"), (6, 1, "")],
                                   "doc_id long, quality int, text string")
    rows = c.score(edge(spark), c.fit(edge(spark), labels)).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["r"][x] == "x" for r in rows for x in CLASHES)
    left = c.keep(edge(spark), labels)
    assert left.columns == edge(spark).columns
    none = c.fit(empty(spark), labels)
    assert c.score(edge(spark), none).first()["score"] == 0.5
    assert c.score(empty(spark), none).collect() == []
    assert c.fit(edge(spark), labels.limit(0)).bias == 0.0


def test_classifier_fit_holds_its_vectors_once():
    import tracemalloc
    texts = [f"word{i} {i} again and again {i % 7}" for i in range(50)]
    tracemalloc.start()
    model = quality_classifier.fit_rows(texts, np.arange(50) % 2)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    vectors = quality_classifier.BUCKETS * quality_classifier.DIM * 4
    assert model.values.shape == (quality_classifier.BUCKETS,)
    assert peak < 1.6 * vectors and held < 0.3 * vectors
