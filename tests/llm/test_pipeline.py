"""The pipeline's stages against plain Python on a small table, each judged on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from loanframe.llm import mixing, quality_classifier, simhash
from loanframe.llm.common import stored, table

from .helpers import SF, edge, empty
from .test_dedup import brute_components
from .test_filters_mixing import WORD, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        seen.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    start, good, single, apart, mixed, packed = seen
    model = quality_classifier.fit(table(spark, SF, "documents"), labels)
    model.values = model.values.astype(np.float32)
    scores = model.scores(pa.array([r["text"] for r in start]))
    assert Counter(good) == Counter(r for r, s in zip(start, scores) if s >= 0.3)
    best = {}
    for r in good:
        best[r["text"]] = max(best.get(r["text"], r), r, key=lambda r: r["doc_id"])
    assert Counter(single) == Counter(best.values())
    single.sort(key=lambda r: r["doc_id"])
    label = brute_components([simhash.fingerprint(r["text"]) for r in single])
    assert Counter(apart) == Counter(single[k] for k in set(label))
    sizes = defaultdict(int)
    for r in apart:
        sizes[r["source"]] += len(re.findall(WORD, r["text"]))
    rate = {s: t / sizes[s] if sizes[s] else 0 for s, t in brute_targets(sizes).items()}
    want = Counter()
    for r in apart:
        x = rate[r["source"]]
        key = f"{mixing.SEED}|{r['doc_id']}|{r['text']}".encode()
        import hashlib
        draw = int(hashlib.md5(key).hexdigest()[:13], 16) / 16 ** 13
        want[r] = int(x) + (draw < x - int(x))
    assert Counter(mixed) == +want
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tok.encode_special_tokens = True
    pieces = Counter()
    for r in mixed:
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 1024):
            pieces[(r["doc_id"], a, zlib.crc32(ids[a:a + 1024].tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in packed) == pieces
    places = [(r["sequence_id"], r["offset"] + k) for r in packed for k in range(r["length"])]
    assert len(set(places)) == len(places) and max(p for _, p in places) < 1024


def test_edges_go_through(spark, tmp_path):
    docs = edge(spark)
    spark.createDataFrame([(1, 1), (4, 0), (100, 1), (101, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, empty(spark)):
        some.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(out) == bool(some.count())
