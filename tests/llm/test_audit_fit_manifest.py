"""Divergence audit, best-fit packing and Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanframe.llm import best_fit, divergence, merkle, oracle, queries
from loanframe.llm.common import table

from tests.oracle_check import compare, duck

from .helpers import SF, edge, edge_rows, empty

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TERM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


# --- divergence audit

@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB é\n-日\x7f"), max_size=60), max_size=6))
def test_slices_count_like_a_plain_regex(some):
    data = [x.encode() for x in some]
    ends = np.cumsum([len(x) for x in data]).astype(np.int64) if data else np.zeros(0, np.int64)
    group = np.array([i % 2 for i in range(len(some))], np.int64)
    got = divergence.count_slice(np.frombuffer(b"".join(data), np.uint8), ends, group)
    n, docs = Counter(), Counter()
    for i, x in enumerate(some):
        for t, k in Counter(terms(x)).items():
            n[t, i % 2] += k
            docs[t, i % 2] += 1
    rows = list(zip(got[0].to_pylist(), got[1].tolist(), got[2].tolist(), got[3].tolist()))
    assert len(rows) == len(n) and all(n[t, g] == a and docs[t, g] == b for t, g, a, b in rows)


def test_pointers_of_long_equal_words_are_sorted():
    rng = random.Random(3)
    stems = ["a" * 7, "a" * 8, "a" * 9, "b" * 300, "b" * 255 + "c", "b" * 256, "b" * 257 + "é" * 200]
    words = [rng.choice(stems) + rng.choice(["", "x", "y" * 20]) for _ in range(400)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, starts, length = divergence.word_pointers(data, np.array([len(data)]))
    order, run = divergence.sort_pointers(low, starts, length)
    got = [low[starts[i]:starts[i] + length[i]].tobytes() for i in order]
    assert got == sorted(w.encode() for w in words)
    assert run.tolist() == [sorted(set(got)).index(x) for x in got]


def plain_audit(rows, ranks=200, scale=10**9):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    by_lang, out = defaultdict(list), set()
    for text, lang, source in rows:
        by_lang[lang or ""].append((source or "", terms(text)))
    for lang, docs in by_lang.items():
        df = Counter(t for _, words in docs for t in set(words))
        kept = {t for t, n in df.items() if n >= 3}
        count = defaultdict(Counter)
        for source, words in docs:
            count[source].update(t for t in words if t in kept)
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in count.items()}, share(every)
        for source, p in shares.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x.encode()) for x, o in shares.items() if x != source]
            tops = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[source][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", tops, ranks)):
                out |= {(lang, source, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(sorted(found)[:most])}
    return out


def test_audit_edges(spark):
    rng = random.Random(4)
    rows = [(t, None, s) for _, t, s in edge_rows()]
    rows += [(" ".join(rng.choice(["ab", "AB", "c", "Éa", "dd", "x1y"]) for _ in range(rng.randrange(30))), rng.choice(["q", "", "z"]),
              rng.choice(["s", "t", "u", None])) for _ in range(60)]
    rows += [("one two", "alone", "s"), ("", "alone", "t"), (None, "alone", None)]  # a language that keeps no term
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "text string, lang string, source string, term string, n string")
    want = plain_audit(rows)
    for cells in (divergence.CELLS, 64 * 2):
        got = divergence.audit(docs, cells=cells).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r[0] == "alone" and r[4] == 0 for r in want)
    few = divergence.audit(docs, term_ranks=2).collect()
    assert {tuple(r) for r in few} == plain_audit(rows, 2)
    assert divergence.audit(empty(spark)).collect() == []


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    ok, said = compare(queries.QUERIES[name](spark, SF), duck(SF), oracle.ORACLE_SQL[name])
    assert ok, said


# --- best-fit packing

def test_open_bins_fit_best_and_close_the_fullest():
    rng = random.Random(1)
    got, bins, full = best_fit.OpenBins(50, 4), {}, {}
    for _ in range(2000):
        n = rng.randint(1, 50)
        room = [50 - used for used in bins.values() if 50 - used >= n]
        bin_, offset, closed = got.put(n)
        if room:
            assert bins[bin_] == offset == 50 - min(room)
        else:
            assert offset == 0 and bin_ not in bins
            if len(bins) == 4:
                assert bins[closed[0]] == max(bins.values())
        bins[bin_] = offset + n
        full[bin_] = bins[bin_]
        for c in closed:
            del bins[c]
        assert len(bins) <= 4 and 50 not in bins.values()
    assert sorted(got.left()) == sorted(bins)


def check_packing(rows, want, size):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in seqs.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


def plain_pieces(docs, size):
    tok, want = Tokenizer.from_file(BYTE), Counter()
    tok.encode_special_tokens = True
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - (-(-len(ids) // size) - 1) * size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return want


def test_best_fit_edges(spark):
    docs = edge(spark)
    for size, bins, group_items in ((2048, 2048, 250_000), (2048, 3, 4), (64, 2, 3)):
        rows = best_fit.pack(docs.repartition(7), BYTE, size=size, bins=bins, group_items=group_items).collect()
        check_packing(rows, plain_pieces([r[:2] for r in edge_rows()], size), size)
    assert best_fit.pack(empty(spark), BYTE).collect() == []


def test_best_fit_uses_few_sequences(spark):
    docs = table(spark, SF, "documents").repartition(5)
    rows = best_fit.pack(docs, BYTE).collect()
    want = plain_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    used = check_packing(rows, want, 2048)
    least = -(-sum(k[3] * n for k, n in want.items()) // 2048)
    assert used <= least * 1.01 + 1
    got = queries.op12_best_fit_packing(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


# --- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, i, arity):
    """(siblings, steps): the siblings bottom up, and each level's run with the place in it."""
    siblings, runs = [], []
    for level in levels[:-1]:
        run, at = level[i // arity * arity:i // arity * arity + arity], i % arity
        siblings += run[:at] + run[at + 1:]
        runs.append((run, at))
        i //= arity
    return siblings, runs


def fold(node, runs):
    for run, at in runs:
        node = sha(*run[:at], node, *run[at + 1:])
    return node


@pytest.mark.parametrize("arity", [2, 3])
def test_nodes_fetched_for_a_block_are_enough_and_no_more(arity):
    for leaves in (1, 2, 3, 7, 16, 29):
        levels = plain_tree([str(i) for i in range(leaves)], arity)
        for first in range(leaves):
            for end in range(first + 1, leaves + 1):
                need = merkle.missing(first, end, leaves, arity)
                given_ = {(a, b): levels[a][b] for a, b in need}
                up = merkle.climb(levels[0][first:end], first, leaves, arity, given_)
                assert up[-1][1] == levels[-1] and len(set(need)) == len(need)
                for level, place in need:  # none of them follows from the leaves of the block
                    lo, hi = place * arity ** level, min((place + 1) * arity ** level, leaves)
                    assert hi <= first or lo >= end
                for i in range(first, end):
                    assert merkle.expand(up, i, arity, "claim") == (plain_path(levels, i, arity)[0], fold("claim", plain_path(levels, i, arity)[1]))
                for level, place, node in merkle.crown(levels[0][first:end], first, leaves, arity):
                    assert levels[level][place] == node


@pytest.mark.parametrize(("arity", "block", "step"), [(2, 1 << 14, 12), (2, 8, 2), (3, 4, 1)])
def test_manifest_by_brute_force(spark, arity, block, step):
    rng = random.Random(9)
    rows = [(i, rng.choice(["en", "en", "en", "fr", None, "", "é"]), rng.choice([None, "s é"]), rng.choice([None, 3]), rng.choice(["t", "", None]))
            for i in [None, None, 5, 5, 5, *range(60)]] + [(100, "one", "s", 1, "x")]
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, lang string, source string, n_chars long, text string, "
                                 "leaf string, block string, pos string").repartition(6)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, lang, s, n, t: sha(*map(field, (i, s, lang, n, t)))
    bad = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    groups = defaultdict(list)
    for r in rows:
        claim = leaf(*r[:3], r[3] + 1 if bad(r[0]) and r[3] is not None else r[3], r[4])
        groups[r[1]].append(((r[0] is not None, r[0] or 0), leaf(*r), claim, r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names], arity)
    want = Counter()
    for k, g in enumerate(names):
        above, over = plain_path(top, k, arity)
        for i, (_, digest, claim, doc) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            below, runs = plain_path(trees[g], i, arity)
            folded = fold(claim, runs + over)
            want[doc, g, digest, claim, trees[g][-1][0], top[-1][0], tuple(below + above), folded, folded == top[-1][0]] += 1
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, claims={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, arity=arity,
                          block=block, step=step)
    got = Counter((r["id"], r["group"], r["leaf"], r["claim"], r["subroot"], r["root"], tuple(r["proof"]), r["folded_root"], r["verified"])
                  for r in got.collect())
    assert got == want
    assert any(not x[8] for x in want) and any(x[8] for x in want)


def test_manifest_edges(spark):
    rows = merkle.manifest(edge(spark)).collect()
    assert Counter(r["id"] for r in rows) == Counter(r[0] for r in edge_rows()) and all(r["verified"] for r in rows)
    assert len({r["root"] for r in rows}) == 1 and pa.array([r["leaf"] for r in rows]).null_count == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(one).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof"] == []
    assert merkle.manifest(empty(spark)).collect() == []
