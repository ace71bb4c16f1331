import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loanframe.llm import exact_dedup, simhash, suffix_dedup, suffix_sort
from loanframe.llm.components import components

from .helpers import CLASHES, edge, edge_rows, empty, texts


@pytest.mark.parametrize("per_filter", [1 << 24, 10])
def test_exact_edges(spark, per_filter):
    rows = exact_dedup.annotate(edge(spark), docs_per_filter=per_filter).collect()
    groups = defaultdict(list)
    for i, t, _ in edge_rows():
        groups[t or ""].append(i)
    assert len(rows) == len(edge_rows())
    kept = Counter()
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == max(ids, default=None)
        kept[text] += r["kept"]
    assert set(kept.values()) == {1}
    left = exact_dedup.deduplicate(edge(spark), docs_per_filter=per_filter)
    assert left.columns == edge(spark).columns
    got = Counter((r["doc_id"], r["text"] or "") for r in left.collect())
    assert got == Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    assert exact_dedup.annotate(empty(spark)).collect() == [] == exact_dedup.deduplicate(empty(spark)).collect()


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_majority():
    import xxhash

    t = "Ab CD\tef\n gh ij kl"
    words = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint(t) == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_edges(spark):
    rows = edge_rows()
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    least = {}
    for k, (i, _, _) in zip(label, rows):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = Counter((i, format(f, "016x"), least.get(k)) for (i, _, _), f, k in zip(rows, fps, label))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.annotate(edge(spark)).collect())
    assert got == want
    left = simhash.deduplicate(edge(spark))
    assert left.columns == edge(spark).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(least.get(k)) for k in set(label))
    assert simhash.annotate(empty(spark)).collect() == [] == simhash.deduplicate(empty(spark)).collect()
    with pytest.raises(ValueError, match="even"):
        simhash.annotate(edge(spark), radius=3)


@pytest.mark.parametrize("most", [2048, 2])
def test_links_reach_all_within_four_bits(spark, most):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            x = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(df, 4, most)).collect()}
    got = [root.get(signed(x), signed(x)) for x in fps]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_suffix_order_and_repeats():
    rng = random.Random(1)
    for _ in range(40):
        sigma = rng.choice([1, 2, 5, 256])
        base = bytes(rng.randrange(sigma) for _ in range(rng.randint(1, 900)))
        t = base + base[rng.randrange(len(base)):] + base[:rng.randrange(len(base))]
        x = np.frombuffer(t, np.uint8)
        order = suffix_sort.suffix_order(x, *suffix_sort.piece_names(x, 100), 100).tolist()
        assert sorted(order) == list(range(len(t)))
        assert [t[i:i + 100] for i in order] == sorted(t[i:i + 100] for i in range(len(t)))
        cells = [t[i:i + rng.randint(1, 600)] for i in range(0, len(t), 37)]
        n = 200
        seen = Counter(c[i:i + n] for c in cells for i in range(len(c) - n + 1))
        for c, hit in zip(cells, suffix_sort.repeated(cells, n)):
            assert [i for i in range(len(c) - n + 1) if seen[c[i:i + n]] > 1] == hit.tolist()


def brute_spans(rows, n=400):
    seen = Counter(t[i:i + n] for t in rows for i in range(len(t) - n + 1))
    out = []
    for t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                hit[i:i + n] = b"\1" * n
        spans, kept = [], bytes(c for c, h in zip(t, hit) if not h)
        for i, h in enumerate(hit):
            if h and (not i or not hit[i - 1]):
                spans.append([i, i])
            if h:
                spans[-1][1] = i + 1
        out.append((spans, kept))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup_by_brute_force(spark, most, monkeypatch):
    whole = suffix_dedup.repeated_ranges
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda t: whole(t, most))
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["kin", "ruß", "to", "ablex", "se"]) + str(rng.randrange(99)) for _ in range(n))
    shared = [say(90) for _ in range(3)]
    rows = [(i, t) for i, t, _ in edge_rows() if t is None or len(t) < 20_000]
    rows += [(200 + i, say(rng.randrange(60)) + shared[i % 3][rng.randrange(40):] + say(rng.randrange(60))) for i in range(24)]
    rows += [(300, shared[0] + say(20) + shared[0] + "ab" * 400), (301, "é" * 350)]
    df = spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in rows],
                               "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got = Counter()
    for r in suffix_dedup.remove_repeats(df).collect():
        got[(r["r"]["doc_id"], r["n_bytes"], str([[s["lo"], s["hi"]] for s in r["spans"]]), bytes(r["kept"]))] += 1
    data = [(t or "").encode() for _, t in rows]
    assert got == Counter((i, len(b), str(s), k) for (i, _), b, (s, k) in zip(rows, data, brute_spans(data)))
    assert sum(len(b) for b in data) > sum(len(k[3]) * n for k, n in got.items())
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []


def test_a_task_sorts_one_row_per_cell_of_a_crowded_core(spark, monkeypatch):
    whole, sort, most = suffix_dedup.repeated_ranges, suffix_dedup._sort_bucket, 10

    def checked(pdf):
        assert not pdf.duplicated(["core", "cell", "part"]).any() and pdf["part"].max() <= 1
        assert pdf.groupby("core")["cell"].nunique().max() <= most
        return sort(pdf)
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda t: whole(t, most))
    monkeypatch.setattr(suffix_dedup, "_sort_bucket", checked)
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    passage, after = say(700), [say(60) for _ in range(3)]
    rows = [say(450) + passage + after[i % 3] + say(450) for i in range(60)]
    rows += [rows[0]] * 9  # copies
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r["r"]["doc_id"]: ([[s["lo"], s["hi"]] for s in r["spans"]], bytes(r["kept"]))
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_spans([t.encode() for t in rows])))


def test_long_texts_are_read_in_stretches(monkeypatch):
    t = "".join(texts())[:30_000].encode()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4096)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([t])], names=["key", "text"])
    first = []
    for out in suffix_dedup._scan(iter([batch])):
        for r in out.to_pylist():
            first += range(r["first"], r["first"] + r["windows"])
    assert first == list(range(len(t) - 399))
