"""Packing documents into training sequences: shortest-pack-first over the length histogram.

A document is its token ids and an end id, cut into full sequences and a rest.
Only the histogram of piece lengths (one row per length up to the sequence
size) reaches the driver.  Lengths are placed longest first, each into the
pattern that is shortest so far, by pattern counts instead of single pieces.
The patterns are joined back by rank: the pieces of a length are numbered, and
a range of numbers belongs to each slot of a pattern.

Numbering is done in buckets of a length, so that a length which a third of
all pieces share is spread over many tasks.

Defined results: a null or empty text is the end id alone; rows that repeat a
document are packed once each; null doc_ids are kept; an empty table gives no
rows; other columns are not used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import lookup_join, stored
from loanframe.llm.tokens import binary_slices, close_documents, encoder

SIZE = 1024
BUCKET_ROWS = 50_000  # about the pieces that one task numbers


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, id_col: str = "doc_id",
           text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """One row per piece: row (a number of its own), id, start, length, doc_tokens, ids (little-endian 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True, special_as_text)
        for batch in batches:
            for at, ids, offsets in enc.slices(batch.column(1)):
                ids, offsets = close_documents(ids, offsets, end_id)
                n = np.diff(offsets)
                k = -(-n // size)
                doc = np.repeat(np.arange(len(n)), k)
                start = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * size
                begin = offsets[doc] + start
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at + doc)), pa.array(start), pa.array(np.minimum(n[doc] - start, size)),
                    pa.array(n[doc]), binary_slices(ids, np.append(begin, len(ids)))], names=schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in (
        "start", "length", "doc_tokens")], T.StructField("ids", T.BinaryType())])
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(cols.mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a pattern, sequences of that pattern) for a histogram of lengths."""
    open_: list[tuple[int, int, list[int], int]] = []  # (-room, number, lengths, sequences)
    made = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, lengths, n = heapq.heappop(open_)
                k = min(n, left)
                if n > k:
                    heapq.heappush(open_, (room, made, lengths, n - k))
                heapq.heappush(open_, (room + length, made + 1, [*lengths, length], k))
                made += 2
                left -= k
            else:
                heapq.heappush(open_, (length - size, made, [length], left))
                made += 1
                left = 0
    return [(lengths, n) for _, _, lengths, n in sorted(open_, key=lambda x: x[1])]


def slots(patterns: list[tuple[list[int], int]], size: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, end rank, sequences, first sequence, offset, padded length): a row for
    each length of each pattern.  Ranks go round the pattern's sequences, then to the next equal slot."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        used = sum(lengths)
        padded = used if used & (used - 1) == 0 else size
        offset = 0
        for length in dict.fromkeys(lengths):
            many = lengths.count(length)
            first = taken.get(length, 0)
            taken[length] = first + many * n
            out.append((length, first, first + many * n, n, sequence, offset, padded))
            offset += many * length
        sequence += n
    return out


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id, offset and padded_length; ``cut`` has columns row and length."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # ``size`` rows at most
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    in_bucket = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    per = keyed.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    bases = stored(per.select("length", "bucket", before.alias("base")), "pack-ranks")
    ranked = lookup_join(keyed.withColumn("in_bucket", in_bucket), bases, ["length", "bucket"], "inner")
    ranked = ranked.withColumn("rank", F.col("base") + F.col("in_bucket"))
    names = "slot_length long, first long, end long, sequences long, first_sequence long, slot_offset long, padded_length long"
    plan = spark.createDataFrame(slots(shortest_pack_first(counts, size), size), names)  # bounded by ``size``
    turn = F.col("rank") - F.col("first")
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("end")))
            .withColumn("sequence_id", F.col("first_sequence") + turn % F.col("sequences"))
            .withColumn("offset", F.col("slot_offset") + F.col("length") * F.floor(turn / F.col("sequences")))
            .select(*cut.columns, "sequence_id", "offset", "padded_length"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, id_col: str = "doc_id",
         text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """All pieces with their ids and places."""
    return place(pieces(docs, tokenizer, end_id, size, id_col, text_col, special_as_text), size).withColumnRenamed("id", id_col).drop("row")
