"""Token output in patched frame-of-reference blocks.

Documents are range-partitioned by id; each task tokenises its range in order
and writes segments, files images of a few hundred thousand ids:

    header   magic "PFR1", number of documents, ids and blocks (unsigned 32-bit)
    lengths  ids of each document, unsigned 32-bit
    index    first byte of each block after the index, and the end (unsigned 32-bit)
    blocks   minimum (unsigned 32-bit), width (byte), number of exceptions (byte),
             128 differences from the minimum at that width, then the places
             (bytes) and the differences (unsigned 32-bit) of the exceptions

The width is that of the PERCENTILE-th difference of a block; larger ones are
exceptions.  Segments are Parquet rows (Spark's writers reach every store)
beside the document ids, the partition, and the ids before the segment in it.

Defined results: a null or empty text is the end id alone; null ids come
first; rows that repeat an id stand side by side, once each; an empty table
gives an empty file set; other columns are not used.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import lookup_join
from loanframe.llm.tokens import binary_slices, close_documents, encoder

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
MAGIC = b"PFR1"


def _bit_width(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]  # 0 for 0, else 1 + floor(log2)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values, one row each, as bytes: value i stands at bit i * width, lowest bit first."""
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, 64).T)  # 64 values fill ``width`` words
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(bit)
        if bit + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """The blocks of values that ``_pack`` wrote."""
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").astype(np.uint64).reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint64)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        lanes[i] = words[word] >> np.uint64(bit)
        if bit + width > 64:
            lanes[i] |= words[word + 1] << np.uint64(64 - bit)
    return (np.ascontiguousarray(lanes.T) & np.uint64((1 << width) - 1)).reshape(len(data), BLOCK).astype(np.int64)


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """The four little-endian bytes of each number."""
    return x.astype("<u4").reshape(-1, 1).view(np.uint8)


def encode_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of some documents' ids."""
    if not len(ids):
        return MAGIC + struct.pack("<3I", len(lengths), 0, 0) + lengths.astype("<u4").tobytes() + struct.pack("<I", 0)
    full = -(-len(ids) // BLOCK) * BLOCK
    rows = np.concatenate([ids, np.full(full - len(ids), ids[-1], ids.dtype)]).reshape(-1, BLOCK).astype(np.int64)
    least = rows.min(axis=1)
    diff = rows - least[:, None]
    nth = -(-BLOCK * PERCENTILE // 100) - 1
    width = _bit_width(np.partition(diff, nth, axis=1)[:, nth])
    odd = (diff >> width[:, None]) > 0
    many = odd.sum(axis=1)
    # Every block's bytes have a known place, so headers, values and exceptions are scattered into one buffer.
    index = np.concatenate([[0], np.cumsum(6 + width * BLOCK // 8 + 5 * many)])
    at, out = index[:-1], np.zeros(index[-1], np.uint8)
    out[at[:, None] + np.arange(4)] = _bytes_of(least)
    out[at + 4], out[at + 5] = width, many
    low = np.where(odd, 0, diff)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        out[at[some][:, None] + 6 + np.arange(w * BLOCK // 8)] = _pack(low[some], w)
    row, place = np.nonzero(odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    begin = (at + 6 + width * BLOCK // 8)[row]
    out[begin + nth] = place
    out[(begin + many[row] + 4 * nth)[:, None] + np.arange(4)] = _bytes_of(diff[row, place])
    head = MAGIC + struct.pack("<3I", len(lengths), len(ids), len(rows))
    return b"".join([head, lengths.astype("<u4").tobytes(), index.astype("<u4").tobytes(), out.tobytes()])


def decode_segment(image: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of all documents, ids of the blocks first..last - 1; by default of all blocks)."""
    if image[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, blocks = struct.unpack_from("<3I", image, 4)
    lengths = np.frombuffer(image, "<u4", docs, 16).astype(np.int64)
    start = np.frombuffer(image, "<u4", blocks + 1, 16 + 4 * docs).astype(np.int64)
    data = np.frombuffer(image, np.uint8, offset=16 + 4 * (docs + blocks + 1))
    last = blocks if last is None else last
    at = start[first:last]
    if not len(at):
        return lengths, np.empty(0, "<u4")
    least = data[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0].astype(np.int64)
    width, many = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    diff = np.zeros((len(at), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        diff[rows] = _unpack(data[at[rows][:, None] + 6 + np.arange(w * BLOCK // 8)], w)
    if many.sum():
        row = np.repeat(np.arange(len(at)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin = (at + 6 + width * BLOCK // 8)[row]
        value = data[(begin + many[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        diff[row, data[begin + nth]] = value
    ids = (diff + least[:, None]).reshape(-1).astype("<u4")
    return lengths, ids[: n - first * BLOCK] if last == blocks else ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text", special_as_text: bool = True) -> None:
    """Writes the token files of all documents, in ascending order of their ids."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.LongType()),
                           T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("docs", T.ArrayType(kind)), T.StructField("image", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, False, special_as_text), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        segment = before = 0

        def image() -> pa.RecordBatch:
            names = pa.concat_arrays([x for x, _, _ in held])
            lengths, ids = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([before], pa.int64()),
                 pa.array([len(ids)], pa.int64()), listed, pa.array([encode_segment(lengths, ids)], pa.binary())],
                names=schema.names)

        for batch in batches:
            for at, ids, offsets in enc.slices(batch.column(1)):
                ids, offsets = close_documents(ids, offsets, end_id)
                i = 0
                while i < len(offsets) - 1:  # whole documents, up to a full segment
                    full = offsets[i] + SEGMENT_IDS - sum(len(x[2]) for x in held)
                    j = min(len(offsets) - 1, int(np.searchsorted(offsets, full)))
                    held.append((batch.column(0).slice(at + i, j - i), np.diff(offsets[i:j + 1]), ids[offsets[i]:offsets[j]]))
                    i = j
                    if sum(len(x[2]) for x in held) >= SEGMENT_IDS:
                        yield image()
                        segment, before, held = segment + 1, before + sum(len(x[2]) for x in held), []
        if held:
            yield image()

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]  # the hash splits rows that repeat an id
    (cols.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
     .write.option("compression", "zstd").parquet(path))


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of token files: id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    files = spark.read.parquet(path)
    per = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition that was written
    bases = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kind = files.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = decode_segment(batch.column(2)[i].as_py())
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, pa.array(cuts[:-1] + batch.column(0)[i].as_py()), pa.array(lengths),
                     binary_slices(ids, cuts)], names=schema.names)

    placed = lookup_join(files, bases, ["part"], "inner")
    return placed.select((F.col("base") + F.col("before")).alias("at"), "docs", "image").mapInArrow(run, schema)
