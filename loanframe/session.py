"""Spark session helpers.

On a cluster the session comes from the platform; these helpers only add
what the library needs and never override a value that is already set.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are written for. AQE re-plans joins and coalesces
# the small post-aggregation shuffles; skew-join splits a hot join key.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Skip Python call-site capture on every Column call (several JVM round
    # trips each); it only enriches error messages.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# A side that grows with the data is broadcast only up to this many counted rows.
MAX_BROADCAST_ROWS = 200_000


# For tables of a few MB on one machine: a split for each core where files allow, and
# joins that deal single-split tables out to all cores instead of broadcasting.
SMALL_TABLES_CONF = {"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loanframe",
                  driver_memory: str = "16g", small_tables: bool = False) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no extra ports)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.default.parallelism", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory)
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.ansi.enabled", "true"))
    for k, v in {**RECOMMENDED_CONF, **(SMALL_TABLES_CONF if small_tables else {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform to a shared file system and is
    used as is; a cluster session without it is an error, since a folder of
    the driver's machine is not seen by the executors. Only a local session
    gets a scratch folder of its own, removed when Python exits.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        d = tempfile.mkdtemp(prefix="loanframe-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCOPES: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the open :func:`scratch` scope, or the shared checkpoint folder."""
    return _SCOPES[-1] if _SCOPES else ensure_checkpoint_dir(spark).rstrip("/")


@contextmanager
def scratch(spark: SparkSession):
    """A scope whose intermediate tables are removed at its end.

    Operators return lazy tables that read their intermediate files, so write
    or collect a result inside the scope. The folder lies under the shared
    checkpoint folder and is removed through Hadoop's file system, whatever
    store that is."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scope-{uuid.uuid4().hex[:12]}"
    _SCOPES.append(base)
    try:
        yield base
    finally:
        _SCOPES.remove(base)
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: cuts lineage (a lost executor re-reads files instead of
    recomputing the whole plan) and lets several reports share one result."""
    spark = df.sparkSession
    path = os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all cores, before work that is dear per row: a table of a few MB, or one with few row
    groups, is read in a few tasks however many cores there are."""
    return df.repartition(F.xxhash64(*df.columns))
