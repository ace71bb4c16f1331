"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point between them that lies
within half the radius of both, so if each emits all its variants within half
the radius, the two meet at a variant.  Emitting the ball of the whole 64 bits
(2,081 variants at radius 4) would move far more data than the texts hold, so
the fingerprint is read as three blocks: two fingerprints that differ in at
most 4 bits differ in at most 2 bits on two of the blocks, and the ball is taken
there, at half that distance (3 x 44 variants).  Fingerprints that meet at a
variant are verified on all 64 bits.

Equal fingerprints are joined before that, and a variant's fingerprints give a
spanning forest of links rather than all pairs.  A variant with more than
MOST_COMPARED fingerprints is not compared pair by pair: those fingerprints
emit the full points within half the radius around it, and all that meet at
such a point are linked, since two of them can't differ in more than the radius.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; of a group the row with the smallest doc_id stays (a null doc_id
ranks last), and one row if that id repeats; an empty table gives no rows;
other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import lookup_join, release, stored
from loanframe.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS = ((0, 21), (21, 42), (42, 64))
MOST_COMPARED = 2048
ROWS_OUT = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 values of a text's word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    value = xxhash.xxh64_intdigest
    h = np.array([value(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1:])], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``fp`` in a struct beside it: r, fp (64 bits as a signed long)."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(x.as_py(), shingle) for x in texts], "<u8").view(np.int64)
        release()
        return pa.array(out)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       of(F.col(text_col).cast("string")).alias("fp"))


def _masks(bits: list[int], radius: int) -> np.ndarray:
    out = [0]
    for k in range(1, radius + 1):
        out += [sum(1 << b for b in some) for some in combinations(bits, k)]
    return np.array(out, np.uint64)


def _pairs_of_blocks(radius: int) -> list[tuple[np.uint64, np.ndarray]]:
    """(mask of two blocks, variants within half the distance that two blocks can be held to)."""
    half = -(-(2 * radius // 3) // 2)
    out = []
    for drop in range(3):
        bits = [b for i, (lo, hi) in enumerate(BLOCKS) if i != drop for b in range(lo, hi)]
        out.append((np.uint64(sum(1 << b for b in bits)), _masks(bits, half)))
    return out


def _emit(radius: int):
    """Variants (key, fp) of each fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _pairs_of_blocks(radius)
        step = max(1, ROWS_OUT // sum(len(v) for _, v in plan))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), step):
                fp = fps[at:at + step]
                key = np.concatenate([((fp & mask)[:, None] ^ v).ravel() for mask, v in plan])
                own = np.concatenate([np.repeat(fp, len(v)) for _, v in plan])
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(own)], names=["key", "fp"])
    return run


def _link(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that stand at the same key (sorted)."""
    left, right, s = [], [], 1
    at = np.arange(len(key) - 1)
    while len(at):
        at = at[at + s < len(key)]
        at = at[key[at] == key[at + s]]
        near = np.bitwise_count(fp[at] ^ fp[at + s]) <= radius
        left.append(at[near])
        right.append(at[near] + s)
        s += 1
    i, j = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero((root != np.arange(len(key))) & (fp != fp[root]))
    return fp[some], fp[root[some]]


def _meet(radius: int, most: int):
    """From variants sorted by key: links (a, b), or rows (key, fp) of crowded variants."""
    names = ["a", "b", "crowded"]

    def rows(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(np.full(len(a), crowded))], names=names)

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs of equal keys; runs are taken together up to a bounded number of pairs."""
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        some, size = new[size > 1], size[size > 1]
        keep = np.repeat(some, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        key, fp = key[keep], fp[keep]
        cost, ends = np.cumsum(size.astype(np.int64) ** 2), np.cumsum(size)
        k = 0
        while k < len(size):
            e = max(k + 1, int(np.searchsorted(cost, (cost[k - 1] if k else 0) + most * most, side="right")))
            lo, hi = (ends[k - 1] if k else 0), ends[e - 1]
            a, b = _link(key[lo:hi], fp[lo:hi], radius)
            if len(a):
                yield rows(a, b, False)
            k = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.uint64)
        flood = None  # the key whose run has outgrown ``most``
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if flood is not None:
                n = int(np.searchsorted(k != flood, True)) if (k != flood).any() else len(k)
                if n:
                    yield rows(k[:n], f[:n], True)
                k, f = k[n:], f[n:]
                flood = flood if not len(k) else None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(new, len(key)))
            big = np.repeat(size > most, size)
            if big.any():
                yield rows(key[big], fp[big], True)
                flood = key[-1] if big[-1] else None
                key, fp = key[~big], fp[~big]
            # The last run may go on in the next batch.
            last = len(key) - int((key == key[-1]).sum()) if len(key) and flood is None else len(key)
            yield from solve(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
        yield from solve(key, fp)
    return run


def _points(radius: int):
    """Full points within half the radius of a fingerprint, around a crowded variant of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _pairs_of_blocks(radius)
        full = [np.uint64((1 << 64) - 1) ^ mask for mask, _ in plan]
        rests = [[_masks([b for b in range(64) if int(m) >> b & 1], r) for r in range(radius // 2 + 1)] for m in full]
        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for key, fp in zip(keys, fps):
                for (mask, _), rest, by_room in zip(plan, full, rests):
                    room = radius // 2 - int(np.bitwise_count((fp & mask) ^ key)) if not key & rest else -1
                    if room >= 0:
                        point = (key | (fp & rest)) ^ by_room[room]
                        yield pa.RecordBatch.from_arrays([_signed(point), _signed(np.full(len(point), fp))],
                                                         names=["key", "fp"])
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All fingerprints at a point (sorted) are linked with its first one."""
    key = root = None
    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        roots = np.where(first < 0, root if root is not None else 0, f[first])
        key, root = k[-1], roots[-1]
        some = roots != f
        yield pa.RecordBatch.from_arrays([pa.array(f[some]), pa.array(roots[some])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST_COMPARED) -> DataFrame:
    """Links (a, b) that join all fingerprints (distinct, column fp) within ``radius`` bits; no link between others."""
    met = fps.select("fp").mapInArrow(_emit(radius), "key long, fp long").repartition("key")
    found = stored(met.sortWithinPartitions("key", "fp").mapInArrow(_meet(radius, most), "a long, b long, crowded boolean"),
                   "simhash-links")
    near = found.where("not crowded").select("a", "b").distinct()
    crowd = found.where("crowded").select("a", "b")
    if not crowd.take(1):
        return near
    points = crowd.mapInArrow(_points(radius), "key long, fp long").distinct().repartition("key")
    return near.unionByName(points.sortWithinPartitions("key", "fp").mapInArrow(_stars, "a long, b long").distinct())


def grouped(rows: DataFrame, id_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (r, fp): (id, fp) of each row, and one row per fingerprint: fp, component_id, whether the
    row that stays has this fingerprint, rows (of the fingerprint) and ties (rows that repeat the id that stays)."""
    if radius % 2:
        raise ValueError("the radius has to be even: two balls of half the radius have to meet")
    ids = stored(rows.select(F.col(f"r.`{id_col}`").alias("id"), "fp"), "simhash-fingerprints")
    rank = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    per = ids.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(
        F.min(F.struct(rank.alias("rank"), "n")).alias("best"), F.sum("n").alias("rows"))
    distinct = stored(per, "simhash-distinct")
    arcs = stored(components(links(distinct, radius)), "simhash-roots")
    roots = arcs.select(F.col("node").alias("fp"), "root").unionByName(
        arcs.select(F.col("root").alias("fp"), "root").distinct())
    linked = stored(distinct.join(roots, "fp"), "simhash-linked")
    least = stored(linked.groupBy("root").agg(F.min("best").alias("least")), "simhash-least")
    best = lookup_join(linked, least, ["root"], "inner").select("fp", "least")
    named = distinct.join(best, "fp", "left").withColumn("least", F.coalesce("least", "best"))
    return ids, stored(named.select(
        "fp", F.col("least.rank.id").alias("component_id"), (F.col("fp") == F.col("least.rank.fp")).alias("stays"),
        "rows", F.col("least.n").alias("ties")), "simhash-groups")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id."""
    ids, groups = grouped(fingerprints(docs, shingle, text_col), id_col, radius)
    out = lookup_join(ids, groups.select("fp", "component_id"), ["fp"], "inner")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """One row of each group, with the columns it came with."""
    rows = fingerprints(docs, shingle, text_col)
    _, groups = grouped(rows, id_col, radius)
    # Only fingerprints of more than one row, or whose group's row is another's, need a look.
    some = groups.where("not stays or rows > 1").select("fp", F.col("component_id").alias("best_id"), "stays", "ties")
    kept = lookup_join(rows, stored(some, "simhash-some"), ["fp"]).where(
        F.col("stays").isNull() | (F.col("stays") & F.col(f"r.`{id_col}`").eqNullSafe(F.col("best_id"))))
    # Rows that share both fingerprint and id with another are still more than one.
    tied = kept.where("ties > 1").groupBy("fp").agg(F.max_by("r", F.xxhash64(F.to_json("r"))).alias("r"))
    return kept.where("ties is null or ties = 1").select("r").unionByName(tied.select("r")).select("r.*")
