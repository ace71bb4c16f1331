"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, their
character n-grams and its word pairs and triples, read by a softmax over the two
classes.  Fitting is numpy stochastic gradient descent on the driver over the
whole texts of at most ``TRAIN_ROWS`` labelled rows of each class, taken in the
order of a hash of the id.  Scoring runs in Spark tasks over whole texts: the
softmax of an average is linear in the features, so each bucket is shipped as
one number (4 MB).

All hashes are taken a slice of texts at a time in numpy, over the code points
of its distinct words; nothing is kept between slices.  A word pair is hashed
from the exclusive-or of its words' hashes, so the order of the two does not
count and all pairs of a word with itself share a bucket, whose vector is learned
like any other.

Defined results: a null or empty text has no features and scores the bias; a
null doc_id counts as held out; of a repeated label the lowest counts; with an
empty table, or labels of one class only, the model is the bias of what was
seen; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import release

BUCKETS, DIM = 1 << 20, 12
GRAMS = (3, 4)
TRAIN_ROWS = 2_000
EPOCHS, RATE, SEED = 6, 2.0, 7
THRESHOLD = 0.3
SLICE_BYTES = 2 << 20  # texts whose features are made at a time in a task
FIT_BYTES = 1 << 18  # the same on the driver, which holds the training rows' features beside them
SLICE_BUCKETS = 1 << 16  # vectors drawn or read at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    """Well spread 64-bit hashes of numbers; each kind of feature has its own."""
    x = x + np.uint64((kind * 0xD6E8FEB86659FD93 + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, offsets of the texts); a text without words has an empty one."""
    flat = pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[ \\t\\n\\x0b\\f\\r]+", " "), " ")
    words = pc.split_pattern(flat, " ")
    coded = words.flatten().dictionary_encode()
    cuts = words.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), cuts - cuts[0]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word of each feature, bucket of each feature): the word itself, and the character n-grams of the
    word marked at both ends. An empty word has none."""
    text = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size + 2)
    begin = end - size - 2
    # A polynomial in the code points, shifted down to the word's own place.
    total = np.concatenate([[np.uint64(0)], np.cumsum(points * _powers(len(points), _BASE)[:-1], dtype=np.uint64)])
    whole = _mix((total[end] - total[begin]) * _powers(len(points), _INVERSE)[begin], 0)
    filled = np.flatnonzero(size)
    of, buckets = [filled], [_bucket(whole[filled])]
    word = np.repeat(np.arange(len(words)), size + 2)
    for n in GRAMS:
        gram = np.zeros(max(len(points) - n + 1, 0), np.uint64)
        for k in range(n):
            gram = gram * _BASE + points[k:k + len(gram)]
        at = np.flatnonzero(np.arange(len(gram)) + n <= end[word[:len(gram)]])
        at = at[size[word[at]] > 0]
        of.append(word[at])
        buckets.append(_bucket(_mix(gram[at], n)))
    return whole, np.concatenate(of), np.concatenate(buckets)


def run_features(whole: np.ndarray, code: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the last word, bucket) of the word pairs, then of the triples; none crosses a text's end."""
    h = whole[code]
    place = np.arange(len(code)) - np.repeat(cuts[:-1], np.diff(cuts))
    pair = _mix(h[1:] ^ h[:-1], 11)
    at = np.flatnonzero(place >= 1)
    yield at, _bucket(pair[at - 1])
    at = np.flatnonzero(place >= 2)
    yield at, _bucket(_mix(pair[at - 2] * _BASE + pair[at - 1], 12))


def slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Consecutive runs of texts of about ``most`` bytes, or SLICE_BYTES."""
    most = SLICE_BYTES if most is None else most
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


@dataclass
class Model:
    values: np.ndarray  # a number for each bucket: its vector read by the softmax
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [self._scores(some) for some in slices(texts)]
        return np.concatenate([*out, np.empty(0)])

    def _scores(self, texts: pa.Array) -> np.ndarray:
        words, code, cuts = _words(texts)
        whole, of, buckets = word_features(words)
        value = np.bincount(of, self.values[buckets], len(words))[code].astype(np.float64)
        count = np.bincount(of, minlength=len(words))[code].astype(np.float64)
        for at, buckets in run_features(whole, code, cuts):
            value[at] += self.values[buckets]
            count[at] += 1
        total, n = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[cuts]) for x in (value, count))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def _documents(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text's features."""
    out = []
    for some in slices(pa.array(texts, pa.string()), FIT_BYTES):
        words, code, cuts = _words(some)
        whole, of, buckets = word_features(words)
        order = np.argsort(of, kind="stable")
        buckets, ends = buckets[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        runs = [(at, b) for at, b in run_features(whole, code, cuts)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mine = code[lo:hi]
            n = ends[mine + 1] - ends[mine]
            place = np.repeat(ends[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts = [buckets[place], *[b[np.searchsorted(at, lo):np.searchsorted(at, hi)] for at, b in runs]]
            found, many = np.unique(np.concatenate(parts), return_counts=True)
            out.append((found.astype(np.int32), (many / max(many.sum(), 1)).astype(np.float32)))
    return out


def fit_rows(texts: list[str | None], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over the rows in a seeded order; both classes weigh the same."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0 if not len(texts) else (4.0 if labels[0] else -4.0))
    docs = _documents(texts)
    rng = np.random.default_rng(SEED)
    vectors = np.empty((BUCKETS, DIM), np.float32)
    for some in np.split(vectors, BUCKETS // SLICE_BUCKETS):
        some[:] = rng.uniform(-1 / DIM, 1 / DIM, some.shape)
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps) * weight[i]
            done += 1
            ids, part = docs[i]
            if not len(ids):
                continue
            rows = vectors[ids]
            hidden = part @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[ids] = rows - part[:, None] * (rate * back).astype(np.float32)
    read = np.concatenate([some @ (out[1] - out[0]) for some in np.split(vectors, BUCKETS // SLICE_BUCKETS)])
    return Model(read, float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """A model of the labelled rows that are not held out."""
    text = F.col(text_col).cast("string")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    rows = []
    for y in (0, 1):  # bounded: TRAIN_ROWS ids, then TRAIN_ROWS rows
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
        of = docs.select(F.col(id_col).alias("id"), text.alias("text"))
        rows += of.join(F.broadcast(some), "id").orderBy(F.xxhash64("id"), "id", "text").limit(TRAIN_ROWS).select("text", "y").collect()
    model = fit_rows([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64))
    # The driver goes on beside its JVM: it gives back what the fit has freed.
    del rows
    gc.collect()
    release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row as struct ``r`` with its score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.values.astype(np.float32), model.bias))

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        scores = Model(*shared.value).scores(texts)
        release()
        return pa.array(scores, pa.float64())

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       of(F.col(text_col).cast("string")).alias("score"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with the columns they came with."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("r.*")
