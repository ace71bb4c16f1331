"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.session import scratch_folder

WORD = "[^\\x20\\x09-\\x0D]+"  # a word: a run without ASCII white space
BROADCAST_ROWS = 200_000  # most rows of a side that is broadcast (a few MB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder (or the scope that is open there)."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later stages, and
    tasks that an executor's loss sends back, read files."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a per-key table: broadcast when its counted rows stay under
    BROADCAST_ROWS, else a shuffled join, whose hot keys AQE splits."""
    n = right.count()
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge"), on, how)


def salts(rows: int) -> int:
    """Salts that keep one key's share of a task near 50,000 rows, however hot the key."""
    return max(256, rows // 50_000)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, so that workers which wait beside the
    executor's heap hold what they use and no more. Called after a batch; a few milliseconds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_KEPT: dict = {}


def worker_cache(name, build):
    """What ``build`` gives, kept by a Python worker over tasks. A worker keeps one operator's
    cache at a time: the next operator that runs in it frees the one before."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[name] = build()
        release()
    return _KEPT[name]
