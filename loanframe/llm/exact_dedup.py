"""Exact deduplication by two-pass Bloom filtering.

Pass one builds a Bloom filter with two-step cells over the SHA-256 hashes of
the texts: a cell knows whether it was hit once or at least twice.  Pass two
tests every hash: if one of its cells was hit once only, the text is unique
and its row passes straight through without a shuffle.  Only possibly
repeated hashes (all repeated ones and a small rate of false alarms, which
the exact grouping clears) are shuffled.

A task sends the cells that its rows hit, block by block of the filter, and a
block's hits meet in one task, which keeps the cells hit twice: some 16 bytes a
row, whatever the number of tasks.  A filter covers at most ``docs_per_filter``
rows (the broadcast bit map has two bytes for each); larger tables are cut into
hash segments that are handled one after the other, and a segment's bit map is
dropped when its rows are written, so neither the filter on the driver nor its
broadcast copies grow with the input.

Defined results: a null text counts as empty; the largest doc_id of equal
texts stays, a null doc_id ranks below all others; of rows that repeat both
doc_id and text exactly one stays; an empty table gives no rows; extra columns
of any name are carried along by ``deduplicate`` and ignored by ``annotate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import folder, salts, stored

CELLS_PER_DOC = 16
HASHES = 4
DOCS_PER_FILTER = 1 << 24  # 2^28 cells: a bit map of 32 MB
BLOCK_CELLS = 1 << 20
TASK_HITS = 1 << 21  # hits that a task gathers before it sends them


def _cells(digests: pd.Series, cells: int) -> np.ndarray:
    """Cells of each digest, one row for each hash function (double hashing)."""
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    a, b = (raw[:, i:i + 8].copy().view("<u8")[:, 0] for i in (0, 8))
    step = b | np.uint64(1)
    return np.stack([(a + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(HASHES)]).astype(np.int64)


def _get(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def _hits(cells: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Places in each block of the filter that a task's rows hit once, and twice or more."""
    def sent(hits: list[np.ndarray]) -> pd.DataFrame:
        hit, n = np.unique(np.concatenate(hits), return_counts=True)
        cuts = np.searchsorted(hit, np.arange(0, cells + 1, BLOCK_CELLS))
        blocks = np.flatnonzero(np.diff(cuts))
        some = [(hit[cuts[b]:cuts[b + 1]] & (BLOCK_CELLS - 1), n[cuts[b]:cuts[b + 1]] > 1) for b in blocks]
        return pd.DataFrame({"block": blocks.astype(np.int32), "once": [x[~y].astype("<u4").tobytes() for x, y in some],
                             "twice": [x[y].astype("<u4").tobytes() for x, y in some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(_cells(pdf["sha"], cells).ravel())
                n += len(held[-1])
            if n >= TASK_HITS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)
    return run


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bit map of one block: the cells that were hit twice or more over all tasks."""
    once, twice = (np.frombuffer(b"".join(pdf[c]), "<u4") for c in ("once", "twice"))
    hit, n = np.unique(once, return_counts=True)
    marks = np.zeros(BLOCK_CELLS, np.uint8)
    marks[hit[n > 1]] = marks[twice] = 1
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "twice": [np.packbits(marks, bitorder="little").tobytes()]})


def _repeated(digests: DataFrame, rows: int) -> tuple[Callable[[Column], Column], Broadcast]:
    """Pass one over a column ``sha``; gives the test of pass two and the bit map that it reads."""
    cells = 1 << max(20, math.ceil(math.log2(CELLS_PER_DOC * max(rows, 1))))
    blocks = (digests.select("sha").mapInPandas(_hits(cells), "block int, once binary, twice binary")
              .groupBy("block").applyInPandas(_twice, "block int, twice binary"))
    bits = np.zeros(cells // 8, np.uint8)
    step = BLOCK_CELLS // 8
    for r in blocks.toLocalIterator():  # one bit map of bounded size
        bits[r["block"] * step:(r["block"] + 1) * step] = np.frombuffer(r["twice"], np.uint8)
    shared = digests.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def again(sha: pd.Series) -> pd.Series:
        if not len(sha):
            return pd.Series([], dtype=bool)
        cell = _cells(sha, cells)
        return pd.Series(_get(shared.value, cell).all(axis=0))
    return again, shared


def _digest(col: Column) -> Column:
    return F.unhex(F.sha2(col.cast("binary"), 256))


def _segments(rows: DataFrame, n: int, docs_per_filter: int) -> list[tuple[DataFrame, int]]:
    """(rows, their number at most) of each hash segment; ``rows`` has a column sha."""
    k = max(1, math.ceil(n / docs_per_filter))
    if k == 1:
        return [(rows, n)]
    cut = rows.withColumn("segment", F.pmod(F.xxhash64("sha"), F.lit(k)).cast("int"))
    spark, path = rows.sparkSession, folder(rows.sparkSession, "exact-segments")
    cut.write.partitionBy("segment").parquet(path)
    return [(spark.read.parquet(path).where(F.col("segment") == i).drop("segment"), 2 * n // k) for i in range(k)]


def _gather(parts: list[Callable[[], tuple[DataFrame, Broadcast]]], name: str) -> DataFrame:
    """The parts' rows; several parts are written one after the other, each with its own bit map."""
    first, shared = parts[0]()
    if len(parts) == 1:
        return first
    path = folder(first.sparkSession, name)
    for i, part in enumerate(parts):
        rows, shared = part() if i else (first, shared)
        rows.write.mode("append").parquet(path)
        shared.unpersist()
    return first.sparkSession.read.parquet(path)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             docs_per_filter: int = DOCS_PER_FILTER) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    key = docs.schema[id_col].dataType
    hashed = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
                         .select("id", _digest(F.col("t")).alias("sha"), F.monotonically_increasing_id().alias("row")),
                         "exact-hashes")

    def part(rows: DataFrame, n: int) -> tuple[DataFrame, Broadcast]:
        again, shared = _repeated(rows, n)
        tested = rows.withColumn("again", again(F.col("sha")))
        alone = tested.where("not again").select(
            "id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
        # A text's rows are counted salt by salt, so one hot text is spread over many tasks.
        some = stored(tested.where("again").drop("again"), "exact-candidates")
        salted = some.withColumn("salt", F.pmod(F.col("row"), F.lit(salts(n))))
        best = F.max(F.struct("id", "row")).alias("best")
        by_salt = salted.groupBy("sha", "salt").agg(best, F.count(F.lit(1)).alias("n"))
        by_text = by_salt.groupBy("sha").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        answer = by_salt.select("sha", "salt").join(by_text, "sha")
        groups = salted.join(answer, ["sha", "salt"]).select(
            "id", "sha", F.col("best.id").alias("keep"), "n", (F.col("row") == F.col("best.row")).alias("kept"))
        return alone.unionByName(groups), shared

    parts = [lambda r=r, n=n: part(r, n) for r, n in _segments(hashed, hashed.count(), docs_per_filter)]
    return _gather(parts, "exact-annotated").select(
        F.col("id").cast(key).alias(id_col), F.col("keep").cast(key).alias("keep_id"), F.col("n").alias("group_size"),
        "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                docs_per_filter: int = DOCS_PER_FILTER) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("sha"))

    def part(seg: DataFrame, n: int) -> tuple[DataFrame, Broadcast]:
        again, shared = _repeated(seg, n)
        tested = seg.withColumn("again", again(F.col("sha")))
        # Partial aggregation leaves one row of a text for each task before the shuffle.
        rank = F.struct(F.col(f"r.`{id_col}`"), F.xxhash64(F.to_json("r")))
        stay = tested.where("again").groupBy("sha").agg(F.max_by("r", rank).alias("r"))
        return tested.where("not again").select("r").unionByName(stay.select("r")), shared

    parts = [lambda r=r, n=n: part(r, n) for r, n in _segments(rows, docs.count(), docs_per_filter)]
    return _gather(parts, "exact-kept").select("r.*")
