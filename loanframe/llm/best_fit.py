"""Best-fit packing of documents into training sequences, online and in bounded space.

A document is its token ids and an end id; only one that is longer than a
sequence is cut, into full pieces behind a shorter first one.  A task packs its
documents as they come, in one pass that tokenises them too:

1. ``bins`` open sequences stand in stacks by the space they have left; bit f of
   an integer says whether a sequence with f tokens left is open.  A piece goes
   to the lowest bit at or above its length, the fullest sequence it fits.
   Pieces that are there together (a slice of a batch, ``bins`` at a time) go in
   longest first, so that short ones fill up what long ones leave.
2. If none has room and all places are taken, the fullest open sequence closes.
   Its pieces leave the task, so a task holds ``bins`` sequences of ids at most.
3. Pieces of the sequences that are open at a task's end are packed again, those
   of all tasks together, ``group_items`` at a time by number and length alone,
   until one group is left.  Only these are joined with their new places; the
   pieces of all sequences that a task closed pass straight through.

Defined results: a null or empty text is the end id alone; rows that repeat a
document are packed once each; null ids are kept; an empty table gives no rows;
other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import lookup_join, stored
from loanframe.llm.tokens import close_documents, encoder

SIZE = 2048
BINS = 2048  # open sequences of a task: 16 MB of ids
GROUP_ITEMS = 250_000  # pieces that one later task packs
BATCH_ROWS = 4096


class OpenBins:
    """At most ``most`` open bins of ``size``, by free space. Bins are numbered as they open."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.opened, self.count = size, most, 0, 0
        self.bits = 0  # bit f: some open bin has f left
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return bin_

    def put(self, length: int) -> tuple[int, int, list[int]]:
        """(bin, offset in it, bins that closed) for a piece of ``length``."""
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.count == self.most:
                closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
                self.count -= 1
            bin_, free = self.opened, self.size
            self.opened += 1
            self.count += 1
        left = free - length
        if left:
            if not self.stacks[left]:
                self.bits |= 1 << left
            self.stacks[left].append(bin_)
        else:
            closed.append(bin_)
            self.count -= 1
        return bin_, self.size - free, closed

    def left(self) -> list[int]:
        """The open bins."""
        return [bin_ for stack in self.stacks for bin_ in stack]


def arrivals(lengths: np.ndarray, bins: int) -> np.ndarray:
    """The order in which pieces are put: ``bins`` of them at a time, longest first."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // bins))


def cut(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of ``n`` tokens: full ones behind the first."""
    k = -(-n // size)
    doc = np.repeat(np.arange(len(n)), k)
    piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    first = (n - size * (k - 1))[doc]
    return doc, piece, np.where(piece == 0, 0, first + size * (piece - 1)), np.where(piece == 0, first, size)


def stream(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, bins: int = BINS, id_col: str = "doc_id",
           text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """One row per piece: row (a number of its own), id, piece, start, length, doc_tokens, bin, offset, open (whether the
    sequence was open at the task's end) and ids (little-endian 32-bit)."""
    names = ["row", "id", "piece", "start", "length", "doc_tokens", "bin", "offset", "open", "ids"]
    types = [T.LongType(), docs.schema[id_col].dataType, T.IntegerType(), *[T.LongType()] * 5, T.BooleanType(), T.BinaryType()]
    schema = T.StructType(list(map(T.StructField, names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_, held = encoder(tokenizer, True, special_as_text), OpenBins(size, bins), {}
        number, out = TaskContext.get().partitionId() << 36, []
        row, id_type = number, None

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), id_type, pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            id_type, listed = batch.column(0).type, batch.column(0).to_pylist()
            for at, ids, offsets in enc.slices(batch.column(1)):
                ids, offsets = close_documents(ids, offsets, end_id)
                n = np.diff(offsets)
                parts = cut(n, size)
                order = arrivals(parts[3], bins)
                doc, piece, start, length = (x[order] for x in parts)
                begin, data = (offsets[doc] + start).tolist(), memoryview(ids.astype("<u4", copy=False)).cast("B")
                for d, p, s, l, b, all_ in zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist(), begin, n[doc].tolist()):
                    bin_, offset, closed = open_.put(l)
                    held.setdefault(bin_, []).append((row, listed[at + d], p, s, l, all_, number + bin_, offset, False,
                                                      bytes(data[4 * b:4 * (b + l)])))
                    row += 1
                    for c in closed:
                        out += held.pop(c)
                    if len(out) >= BATCH_ROWS:
                        yield flush()
        for bin_ in open_.left():
            out += [(*x[:8], True, x[9]) for x in held.pop(bin_)]
            if len(out) >= BATCH_ROWS:
                yield flush()
        if out:
            yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _again(size: int, bins: int):
    """New places of the pieces (row, length) of one group: bin, offset, and whether the bin is open at the end.
    A bin has the number of its first piece."""
    def run(pieces: pa.Table) -> pa.Table:
        open_, first, at = OpenBins(size, bins), [], []
        pieces = pieces.sort_by("row")
        pieces = pieces.take(pa.array(arrivals(pieces["length"].to_numpy(), bins)))
        for row, length in zip(pieces["row"].to_pylist(), pieces["length"].to_pylist()):
            bin_, offset, _ = open_.put(length)
            if bin_ == len(first):
                first.append(row)
            at.append((bin_, offset))
        left = set(open_.left())
        return pa.table({"row": pieces["row"], "length": pieces["length"], "bin": pa.array([first[b] for b, _ in at], pa.int64()),
                         "offset": pa.array([o for _, o in at], pa.int64()), "open": pa.array([b in left for b, _ in at], pa.bool_())})
    return run


def _settled(pieces: DataFrame, size: int, bins: int, group_items: int) -> DataFrame:
    """(row, bin, offset) of pieces (row, length): packed in groups, those in bins that stay open in fewer groups again."""
    done, n = None, pieces.count()
    while True:
        groups = max(1, -(-n // group_items))
        step = stored(pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group")
                      .applyInArrow(_again(size, bins), "row long, length long, bin long, offset long, open boolean"), "fit-again")
        placed = (step if groups == 1 else step.where("not open")).select("row", "bin", "offset")
        done = placed if done is None else done.unionByName(placed)
        if groups == 1:
            return done
        pieces, before = step.where("open").select("row", "length"), n
        n = pieces.count()
        if n * 2 > before:  # the groups are too small for their open bins
            group_items *= 2


def settle(pieces: DataFrame, size: int = SIZE, bins: int = BINS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The pieces of ``stream`` with sequence_id in place of bin; pieces of sequences that no task closed are packed again."""
    kept = stored(pieces, "fit-pieces")
    rest = kept.where("open")
    places = _settled(rest.select("row", "length"), size, bins, group_items)
    # New bins have numbers of rows, below zero here, so that none is the number of a task's bin.
    places = places.select("row", (-1 - F.col("bin")).alias("bin"), "offset")
    moved = lookup_join(rest.drop("bin", "offset"), places, ["row"], "inner").select(*kept.columns)
    return kept.where("not open").unionByName(moved).drop("row", "open").withColumnRenamed("bin", "sequence_id")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, bins: int = BINS, id_col: str = "doc_id",
         text_col: str = "text", special_as_text: bool = True, group_items: int = GROUP_ITEMS) -> DataFrame:
    """All pieces with their ids, sequences and offsets."""
    pieces = stream(docs, tokenizer, end_id, size, bins, id_col, text_col, special_as_text)
    return settle(pieces, size, bins, group_items).withColumnRenamed("id", id_col)
