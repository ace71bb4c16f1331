"""Source divergence audit: how far the term shares of each source are from the other sources' of its language.

1. A task lower-cases a slice of its Arrow text buffer and takes a pointer to
   the start of every word.  A multikey quicksort orders the pointers: by the
   next eight bytes, then, among equal ones whose words go on, by the eight
   after these.  Equal runs are terms; the run's documents, ordered by (lang,
   source), give counts and document frequency of the term in each of them.
2. One shuffle by (lang, term) adds up what the slices found, which tells the
   kept terms and the language's counts too.
3. Shares are exact integers (billionths).  The divergence of a pair of sources
   is added up in tables of some terms by all sources of a language, ``CELLS``
   cells a task, so that no pair is written for a single term.

Defined results: null text, lang and source are empty strings; a group without
kept terms has divergences of its smoothed shares alone (0 if the language keeps
none); ties rank by item in UTF-8 order; an empty table gives no rows; other
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanframe.llm.common import lookup_join, stored, text_or_empty

MIN_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
SLICE_BYTES = 8 << 20
CELLS = 1 << 18  # terms x sources of one task's table; at least MIN_TERMS terms
MIN_TERMS = 64
KEYED = 32  # rounds of eight bytes; what is equal that far is compared as a whole

# Bytes of a word: ASCII letters (lower-cased) and all beyond ASCII; every other byte ends a word.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_FIRST = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9))], np.uint64)


def word_pointers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start and length of each word) of documents that end at ``ends``; no word crosses an end."""
    low = _LOWER[data]
    inside = np.concatenate([[False], low != 0, [False]])
    rises, falls = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(low))]
    both = cuts[(low[cuts] != 0) & (low[cuts - 1] != 0)]
    rises[both] = falls[both] = True
    starts = np.flatnonzero(rises)
    return low, starts, np.flatnonzero(falls) - starts


def _keys(windows: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes at each start as a number, zeros behind the word's end."""
    return windows[starts].astype(np.uint64) & _FIRST[np.minimum(length, 8)]


def sort_pointers(low: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by their bytes, number of the equal run of each word in that order)."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    windows = np.ndarray((len(low) + 1,), ">u8", padded, strides=(1,))
    keys = _keys(windows, starts, length)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(order) else np.zeros(0, bool)
    goes_on = (keys & np.uint64(0xFF)) != 0
    at = np.flatnonzero(goes_on)
    for depth in range(8, 8 * KEYED, 8):
        # Only runs of two words or more can part any further.
        run = np.cumsum(new) - 1
        at = at[np.bincount(run)[run[at]] > 1] if len(at) else at
        if not len(at):
            return order, np.cumsum(new) - 1
        mine = order[at]
        keys = _keys(windows, np.minimum(starts[mine] + depth, len(low)), np.maximum(length[mine] - depth, 0))
        by = np.lexsort((keys, run[at]))
        order[at], keys = mine[by], keys[by]
        new[at[1:]] |= (keys[1:] != keys[:-1]) & (run[at[1:]] == run[at[:-1]])
        at = at[(keys & np.uint64(0xFF)) != 0]
    run = np.cumsum(new) - 1
    at = at[np.bincount(run)[run[at]] > 1] if len(at) else at
    words = [(r, low[starts[i]:starts[i] + length[i]].tobytes(), i) for r, i in zip(run[at].tolist(), order[at].tolist())]
    words.sort()
    for k, (a, x) in enumerate(zip(at.tolist(), words)):
        order[a] = x[2]
        if k and words[k - 1][0] == x[0] and words[k - 1][1] != x[1]:
            new[a] = True
    return order, np.cumsum(new) - 1


def count_slice(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, count, documents) of the documents that end at ``ends``, each of a numbered group."""
    low, starts, length = word_pointers(data, ends)
    order, run = sort_pointers(low, starts, length)
    by_group = np.argsort(group, kind="stable")  # documents of a group get consecutive numbers
    number = np.empty(len(group), np.int64)
    number[by_group] = np.arange(len(group))
    doc = number[np.searchsorted(ends, starts, side="right")]
    pairs = np.sort(run * len(group) + doc[order])
    new_doc = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
    term, of = np.divmod(pairs, max(len(group), 1))
    of = group[by_group][of] if len(pairs) else of
    first = np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]) if len(pairs) else new_doc
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(pairs)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else counts
    leads = order[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] if len(run) else order
    size = length[leads]
    cuts = np.concatenate([[0], np.cumsum(size)])
    spelt = low[np.repeat(starts[leads] - cuts[:-1], size) + np.arange(cuts[-1])]
    words = pa.Array.from_buffers(pa.string(), len(leads), [None, pa.py_buffer(cuts.astype("<i4")), pa.py_buffer(spelt.tobytes())])
    return words.take(pa.array(term[at])), of[at], counts, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, source, n, docs of each slice of documents (lang, source, text)."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        if not len(texts):
            continue
        pair = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        known: dict[tuple, int] = {}
        group = np.array([known.setdefault((p["lang"], p["source"]), len(known)) for p in pair.to_pylist()], np.int64)
        langs, sources = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, "<i8", len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            term, of, n, docs = count_slice(data[offsets[at]:offsets[end]], offsets[at + 1:end + 1] - offsets[at], group[at:end])
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([langs.take(of), term, sources.take(of), pa.array(n), pa.array(docs)],
                                             names=["lang", "term", "source", "n", "docs"])
            at = end


def _pair_sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over some terms of a language: (lang, source, item, value) for each pair of its sources."""
    groups = groups.sort_by("source")
    sources, base = groups["source"].to_pylist(), groups["base"].to_numpy().astype(np.int64)
    place = {s: i for i, s in enumerate(sources)}
    coded = cells["term"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    share = np.tile(base, (len(coded.dictionary), 1))
    share[coded.indices.to_numpy(), [place[s] for s in cells["source"].to_pylist()]] = cells["p"].to_numpy()
    out = []
    for i in range(len(sources)):
        gap = share[:, i:i + 1] - share
        out.append((gap * gap // share).sum(axis=0))
    value, n = np.array(out, np.int64).reshape(len(sources), -1), len(sources)
    one, other = np.nonzero(~np.eye(n, dtype=bool))
    named = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(one), pa.string()), "source": named.take(pa.array(one)),
                     "item": named.take(pa.array(other)), "value": pa.array(value[one, other], pa.int64())})


def _share(count: str, total: str, terms: str, scale: int) -> F.Column:
    """1 + floor(scale * (count + 1) / (total + terms)) in exact arithmetic (1 if the language keeps no term)."""
    return F.expr(f"1 + if({total} + {terms} = 0, 0, (cast({count} + 1 as decimal(28, 0)) * {scale}) div ({total} + {terms}))")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
          term_ranks: int = TERM_RANKS, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    plain = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"),
                        text_or_empty(text_col).alias("text"))
    found = plain.select("lang", "source", "text").mapInArrow(_count, "lang string, term string, source string, n long, docs long")
    # One shuffle by (lang, term) serves both the counts and the sums over a term's sources.
    each = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = each.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term)).withColumn(
        "lead", (F.min("source").over(term) == F.col("source")).cast("long"))
    kept = stored(sums.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "lead"), "divergence-terms")
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("led"))
    every = plain.select("lang", "source").groupBy("lang", "source").agg(F.lit(0).cast("long").alias("none"))
    groups = stored(every.drop("none").join(per, ["lang", "source"], "left").fillna(0, ["total", "led"]), "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("led").alias("terms"), F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    langs = stored(langs.withColumn("buckets", F.expr(
        f"greatest(1, cast(terms div greatest({MIN_TERMS}, {cells} div sources) as int))")), "divergence-langs")
    groups = stored(lookup_join(groups.drop("led"), langs, ["lang"], "inner").withColumn(
        "base", _share("0", "total", "terms", scale)), "divergence-bases")
    shares = lookup_join(kept, groups, ["lang", "source"], "inner").withColumn("p", _share("n", "total", "terms", scale))

    q = _share("lang_n", "lang_total", "terms", scale)
    over = shares.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= term_ranks)

    table = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "term", "source", "p")
    spread = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets").cast("long") - 1)).alias("bucket"), "source", "base")
    parts = table.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
