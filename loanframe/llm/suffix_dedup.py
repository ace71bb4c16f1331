"""Suffix-array deduplication: removes bytes covered by long strings that start more than once.

1. Each ``LENGTH``-byte window is filed under its smallest GRAM-byte piece
   (by hash, leftmost first).  Equal windows have the same piece at the same
   place, so neighbouring windows with one piece form a cell, and windows can
   only be equal inside the cells of one piece (the core).
2. Cells are counted by core and content (a 64-bit hash).  A cell that is
   alone in its core is not repeated; its bytes are not needed.
3. The bytes of all other cells are brought together by core and put through a
   two-stage suffix sort; windows whose common prefix with a neighbour reaches
   the length are repeated.  Of a kind of cell that occurs more than once, however
   often, two go through the sort, and what the sort finds in the first holds
   for all of that kind.
4. A core with more than MOST_CELLS different cells is cut into finer cells,
   filed under longer pieces (369 bytes, then the whole window), so no group has
   to fit one task.  Here, cells that occur more than once are told by their
   hashes; the different ones are sorted.

Texts are known by their 128-bit digest, so copies of a text share one list of
spans.  Defined results: a null text is empty; texts shorter than the length
keep all bytes; rows that repeat a text repeat its windows (all of it goes if
it is long enough); an empty table gives no rows; extra columns, whatever their
names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import BROADCAST_ROWS, stored
from loanframe.llm.suffix_sort import repeated

LENGTH, GRAM = 400, 32
MOST_CELLS = 1000  # different cells of one core that one task sorts
FINER = (32, 1)  # offsets of the core within a window that finer cells share
BUCKET_BYTES, SORT_BYTES = 4 << 20, 1 << 18
CHUNK = 1 << 18
_PLACE = np.uint64((1 << 28) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place (doubling a polynomial hash)."""
    h, base, size = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data], 0xD6E8FEB86659FD93, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def cells_of(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of texts that stand in ``data``: text, first window, windows, place of the core in
    the cell, hash of the core, hash of the cell's bytes."""
    import xxhash

    flat = np.frombuffer(data, np.uint8)
    grams = _gram_hashes(flat)
    least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    core = (least & _PLACE).astype(np.int64)
    n = sizes - LENGTH + 1  # windows of each text
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    core = core[at]
    new = np.concatenate([[True], (np.diff(core) != 0) | (np.diff(at) != 1)])
    first, windows, core = at[new], np.diff(np.append(np.flatnonzero(new), len(at))), core[new]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + windows + LENGTH - 1).tolist())], np.uint64)
    text = np.searchsorted(starts, first, side="right") - 1
    return text, first - starts[text], windows, core - first, grams[core].view(np.int64), content.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each text: key, first, windows, anchor, core, cell."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        long_, k = np.flatnonzero(size >= LENGTH), 0
        total = np.cumsum(size[long_])
        while k < len(long_):
            e = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CHUNK, side="right")))
            rows, k = long_[k:e], e
            data = b"".join(texts[i].as_py() for i in rows.tolist())
            # A very long text is read in stretches that overlap by one window, so each window is read once.
            ends = np.cumsum(size[rows])
            if len(rows) == 1:
                pieces = [(data[a:a + CHUNK + LENGTH - 1], np.array([0]), a) for a in range(0, len(data) - LENGTH + 1, CHUNK)]
            else:
                pieces = [(data, ends - size[rows], 0)]
            for part, starts, shift in pieces:
                sizes = np.diff(np.append(starts, len(part)))
                text, first, windows, anchor, core, cell = cells_of(part, starts, sizes)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows[text])), pa.array((first + shift).astype(np.int64)),
                     pa.array(windows.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(core), pa.array(cell)],
                    names=["key", "first", "windows", "anchor", "core", "cell"])


CELLS = "key binary, first long, windows int, anchor int, core long, cell long"


# Of a wanted cell: once says that it has no equal, part tells the two apart that stand for the others.
FIELDS = ["first", "windows", "anchor", "core", "cell", "once", "kinds", "part"]


def _counted(cells: DataFrame) -> DataFrame:
    """(core, cell, n, kinds) of the cells that may hold a repeated window; both counts combine before the shuffle."""
    per = stored(cells.groupBy("core", "cell").agg(F.count(F.lit(1)).alias("n")), "suffix-counts")
    kinds = stored(per.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-kinds")
    told = per.join(kinds.hint("merge"), ["core"], "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    return stored(told.where("n > 1 or kinds > 1"), "suffix-told")


def _ranges(cells: DataFrame) -> DataFrame:
    """Bytes that the windows of whole cells cover."""
    return cells.select("key", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + (LENGTH - 1)).alias("hi"))


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted cells of each text; a task reads a text once, however many copies it meets."""
    done: set[bytes] = set()
    for batch in batches:
        for key, text, wanted in zip(*(batch.column(i) for i in range(3))):
            if (key := key.as_py()) in done:
                continue
            done.add(key)
            text = text.as_py()
            want = wanted.values.flatten()
            first, windows = want[0].to_pylist(), want[1].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(first), pa.binary()), *want,
                 pa.array([text[a:a + n + LENGTH - 1] for a, n in zip(first, windows)], pa.binary())],
                names=["key", *FIELDS, "bytes"])


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranges that repeated windows cover in the cells of a bucket of cores: of a text, for cells without an
    equal; of the cell itself (no key, but core and cell), for the first of two that stand for the others.

    The cores of a bucket are sorted some at a time, since short strings sort faster."""
    pdf = pdf.sort_values("core", kind="stable")
    done = (pdf["bytes"].map(len).cumsum() // SORT_BYTES).to_numpy()
    new = np.concatenate([[True], np.diff(pdf["core"].to_numpy()) != 0])
    out = []
    for _, part in pdf.groupby(done[np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))]):
        for r, hit in zip(part.itertuples(), repeated(list(part["bytes"]), LENGTH)):
            if len(hit) and r.part == 0:
                runs = np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1)
                key, first, core, cell = (r.key, r.first, None, None) if r.once else (None, 0, r.core, r.cell)
                out += [(key, core, cell, first + int(x[0]), first + int(x[-1]) + LENGTH) for x in runs]
    key, core, cell, lo, hi = zip(*out) if out else [()] * 5
    # Nullable integers from the start: hashes don't survive a float column.
    return pd.DataFrame({"key": pd.Series(key, dtype=object), "core": pd.array(core, "Int64"), "cell": pd.array(cell, "Int64"),
                         "lo": np.array(lo, np.int64), "hi": np.array(hi, np.int64)})


def _finer(width: int):
    """Cells of ``width`` core places, from cells of more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = lambda x: np.array(xxhash.xxh3_64_intdigest(x), np.uint64).view(np.int64).item()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                anchor, data = r["anchor"], r["bytes"]
                for j in range(max(0, anchor - r["windows"] + 1) // width, anchor // width + 1):
                    lo, hi = max(0, anchor - width * (j + 1) + 1), min(r["windows"] - 1, anchor - width * j)
                    if lo <= hi:
                        at = anchor - width * j  # the bytes that all windows of this cell share begin here
                        core = data[at:at + LENGTH - width + 1]
                        part = data[lo:hi + LENGTH]
                        out.append((r["key"], r["first"] + lo, hi - lo + 1, anchor - lo, digest(b"%d " % j + core),
                                    digest(part), r["once"], 0, part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, (
                    pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))],
                names=["key", "first", "windows", "anchor", "core", "cell", "once", "part", "bytes"])
    return run


def _distinct(cells: DataFrame) -> DataFrame:
    """One row per core, cell and part, combined before the shuffle; cells that occur once are alone already."""
    return cells.where("once").unionByName(cells.where("not once").dropDuplicates(["core", "cell", "part"]))


def _sorted_ranges(cells: DataFrame) -> DataFrame:
    """What ``_sort_bucket`` finds in cells with bytes whose cores have MOST_CELLS kinds at most."""
    size = cells.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    return (_distinct(cells.select("key", "first", "core", "cell", "once", "part", "bytes"))
            .withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(_sort_bucket, "key binary, core long, cell long, lo long, hi long"))


def repeated_ranges(texts: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(key, lo, hi): byte ranges covered by repeated windows; ``texts`` has columns key and text (binary)."""
    cells = stored(texts.select("key", "text").mapInArrow(_scan, CELLS), "suffix-cells")
    # These sides grow with the input, so the joins are shuffled at every size; both sides of
    # each are read from files or scans, so AQE can split a hot key.
    flagged = stored(cells.join(_counted(cells).hint("merge"), ["core", "cell"]), "suffix-flagged")
    crowded = F.col("kinds") > most_cells
    found = [_ranges(flagged.where((F.col("n") > 1) & crowded))]
    # Cells without an equal, and two of each kind that has some (one in a crowded core).
    fields = [x for x in FIELDS if x != "part"]
    known = flagged.withColumn("once", F.col("n") == 1)
    alone = known.where("once").select("key", *fields, F.lit(0).alias("part"))
    pick = F.struct("key", *fields)
    two = known.where("not once").groupBy("core", "cell").agg(F.min(pick).alias("a"), F.max(pick).alias("b"))
    two = two.select(F.posexplode(F.array("a", "b")).alias("part", "x")).select("x.*", "part").where(~crowded | (F.col("part") == 0))
    wanted = alone.unionByName(two.select("key", *FIELDS))
    lists = stored(wanted.groupBy("key").agg(F.collect_list(F.struct(*FIELDS)).alias("wanted")), "suffix-wanted")
    schema = T.StructType([T.StructField("key", T.BinaryType()), *[wanted.schema[f] for f in FIELDS],
                           T.StructField("bytes", T.BinaryType())])
    got = texts.select("key", "text").join(lists.hint("merge"), "key").select("key", "text", "wanted")
    some = stored(got.mapInArrow(_cut_bytes, schema), "suffix-bytes")
    sorted_ = stored(_sorted_ranges(some.where(~crowded)), "suffix-sorted")
    found.append(sorted_.where("key is not null").select("key", "lo", "hi"))
    # What holds for the first of a kind holds for all of it.
    kinds = sorted_.where("key is null").select("core", "cell", "lo", "hi")
    found.append(flagged.where((F.col("n") > 1) & ~crowded).select("key", "first", "core", "cell").join(kinds.hint("merge"), ["core", "cell"])
                 .select("key", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))
    for width in FINER:
        crowd = some.where(crowded)
        if not crowd.take(1):
            break
        crowd = _distinct(crowd).select("key", "first", "windows", "anchor", "core", "cell", "once", "part", "bytes")
        parts = stored(crowd.mapInArrow(_finer(width), crowd.schema), "suffix-finer")
        told = stored(parts.join(_counted(parts).hint("merge"), ["core", "cell"]), "suffix-told")
        found.append(_ranges(told.where("n > 1 and once")))
        # Parts that occur more often have their ranges; one of each stands for them among the others of its core.
        some = told.where("kinds > 1").withColumn("once", F.expr("once and n = 1")).drop("n")
        found.append(_sorted_ranges(some.where(~crowded)).where("key is not null").select("key", "lo", "hi"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _merged(ranges: Column) -> Column:
    """Maximal runs of a sorted list of ranges."""
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        return F.when(r["lo"] <= last["hi"], F.array_append(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(
            F.array_append(done, r))
    return F.reduce(ranges, none, add)


def _apply(names: list[str]):
    """The bytes that stay outside the spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, n = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                text, ranges = text.as_py(), ranges.as_py() or []
                cuts = [0, *(x for r in ranges for x in (r["lo"], r["hi"])), len(text)]
                spans.append(ranges)
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                n.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                names=names)
    return run


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as struct ``r`` with n_bytes, spans (lo, hi of maximal removed runs) and kept (the remaining bytes)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), _bytes(F.col(text_col)).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    ranges = repeated_ranges(docs.select(_bytes(F.col(text_col)).alias("text")).withColumn("key", F.unhex(F.md5("text"))))
    # A set: copies of a text name the same ranges, so a list stays as short as one text's.
    found = ranges.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    spans = stored(found.select("key", _merged(F.col("ranges")).alias("ranges")), "suffix-spans")
    many = spans.agg(F.sum(F.size("ranges"))).first()[0] or 0
    spans = F.broadcast(spans) if many <= BROADCAST_ROWS else spans.hint("merge")
    schema = T.StructType([rows.schema["r"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", spans.schema["ranges"].dataType), T.StructField("kept", T.BinaryType())])
    return rows.join(spans, "key", "left").select("r", "text", "ranges").mapInArrow(_apply(schema.names), schema)
