import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanframe.llm import packing, token_files, tokens
from loanframe.llm.common import folder
from loanframe.llm.tokens import UnitEncoder

from .helpers import edge, edge_rows, empty, texts

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
NASTY = ["", " ", "a  b\n\n c ", "a  b", "x\x00y <|endoftext|> don't I'll", "\n\nA\tb \t c\r\n d", None, "日本語 テスト。",
         "Σας ΟΔΟΣ İstanbul éÉ é", "foo, bar... (baz) 12,345.6 !!", " lead", "trail ", "\n", "a\n b", "x y z"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaces"), [(BYTE, True), (WORD, False)])
def test_units_equal_one_call(path, spaces):
    one, enc = plain(path), UnitEncoder(path, spaces)
    every = NASTY + texts()[:60]
    ids, offsets = enc.encode(pa.array(every, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [one(x) for x in every]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZé́ \n\t.,!1_<| \x0b\x1cß"), max_size=25), max_size=4))
def test_units_equal_one_call_on_odd_texts(some):
    for path, spaces in ((BYTE, True), (WORD, False)):
        enc = ENCODERS.setdefault(path, (UnitEncoder(path, spaces), plain(path)))
        ids, offsets = enc[0].encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc[1](x) for x in some]


ENCODERS: dict = {}


def test_queries_give_the_ids_of_an_unchanged_tokenizer(spark, tmp_path):
    import corpus_pipeline
    from loanframe.llm import queries

    every = [x for x in NASTY if x] + ["a <|endoftext|> b<|startoftext|>", "<|endoftext|><|endoftext|> x ", "<|ENDOFTEXT|> y  <|endoftext|>"]
    for path, spaces in ((BYTE, True), (WORD, False)):
        enc, tok = UnitEncoder(path, spaces, special_as_text=False), Tokenizer.from_file(path)
        ids, offsets = enc.encode(pa.array(every, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tok.encode(x, add_special_tokens=False).ids for x in every]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for query, path, end in ((queries.op1_pack_documents, BYTE, 0), (queries.op7_token_files, WORD, 1)):
        one = Tokenizer.from_file(path)
        want = {i: zlib.crc32(np.array([*one.encode(x, add_special_tokens=False).ids, end], "<u4").tobytes()) for i, x in enumerate(every)}
        assert {r["doc_id"]: r["ids_crc32"] for r in query(spark, str(tmp_path)).collect()} == want
    one = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.pack_documents(spark, docs, str(tmp_path)).collect()}
    assert got == {i: np.array([*one.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in enumerate(every)}


def test_patterns_place_every_piece():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 64) for _ in range(3000))
    patterns = packing.shortest_pack_first(dict(counts), 64)
    placed = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            placed[x] += n
    assert placed == counts
    used = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in patterns) * 64 < used * 1.02
    assert packing.shortest_pack_first({}, 64) == []


def test_pack_edges(spark):
    rows = packing.pack(edge(spark), BYTE).collect()
    one = plain(BYTE)
    want = Counter()
    for i, t, _ in edge_rows():
        ids = np.array([*one(t), 0], "<u4")
        for a in range(0, len(ids), 1024):
            part = ids[a:a + 1024]
            want[(i, a, len(part), len(ids), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], zlib.crc32(r["ids"])) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for some in seqs.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and {r["padded_length"] for r in some} == {at if at & (at - 1) == 0 else 1024}
    assert packing.pack(empty(spark), BYTE).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_segment_round_trip(ids):
    data = np.array(ids, "<u4")
    lengths = np.array([len(ids) // 3, len(ids) - len(ids) // 3])
    got = token_files.decode_segment(token_files.encode_segment(lengths, data))
    assert got[0].tolist() == lengths.tolist() and got[1].tolist() == ids


def plain_image(lengths, ids):
    """A segment written value by value, as the module's layout says."""
    blocks = []
    for a in range(0, len(ids), 128):
        block = [*ids[a:a + 128], *[ids[-1]] * (a + 128 - len(ids))]
        low = min(block)
        diff = [x - low for x in block]
        width = sorted(diff)[115].bit_length()
        odd = [i for i, d in enumerate(diff) if d >> width]
        bits = sum((0 if d >> width else d) << (i * width) for i, d in enumerate(diff))
        blocks.append(struct.pack("<IBB", low, width, len(odd)) + bits.to_bytes(16 * width, "little") + bytes(odd)
                      + b"".join(struct.pack("<I", diff[i]) for i in odd))
    index = [0, *np.cumsum([len(b) for b in blocks]).tolist()]
    return b"".join([b"PFR1", struct.pack("<3I", len(lengths), len(ids), len(blocks)), struct.pack(f"<{len(lengths)}I", *lengths),
                     struct.pack(f"<{len(index)}I", *index), *blocks])


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32])
def test_images_equal_a_plain_writer(top):
    rng = np.random.default_rng(top)
    for n in (1, 127, 128, 129, 2000):
        ids = rng.integers(0, top, n).astype("<u4")
        ids[rng.integers(0, n, n // 20)] = 2**32 - 1
        assert token_files.encode_segment(np.array([n]), ids) == plain_image([n], ids.tolist())


def test_a_full_memo_keeps_the_ids_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 4000)
    every = texts()[:40]
    for path, spaces in ((BYTE, True), (WORD, False)):
        one, enc = plain(path), UnitEncoder(path, spaces)
        for _ in range(2):
            for at, ids, offsets in enc.slices(pa.array(every, pa.string()), 20_000):
                assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [one(x) for x in every[at:at + len(offsets) - 1]]
                assert enc.known.nbytes + enc.known_ids.nbytes <= 4000


def test_block_index_reads_a_stretch():
    data = np.random.default_rng(1).integers(0, 50_000, 1000).astype("<u4")
    _, ids = token_files.decode_segment(token_files.encode_segment(np.array([1000]), data), 2, 4)
    assert ids.tolist() == data[256:512].tolist()


def test_token_files_edges(spark):
    path = folder(spark, "test-token-files")
    token_files.write(edge(spark), path, WORD)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    one = plain(WORD)
    want = Counter((i, tuple([*one(t), 1])) for i, t, _ in edge_rows())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    at, last = 0, -1
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        assert (r["doc_id"] or -1) >= last or r["doc_id"] is None and last == -1
        at, last = at + r["n_tokens"], r["doc_id"] or -1
    path = folder(spark, "test-token-files")
    token_files.write(empty(spark), path, WORD)
    assert token_files.read(spark, path).collect() == []
