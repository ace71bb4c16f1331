"""Structured Streaming entry points.

Scoring and normalisation are stateless projections, so the batch operators
apply unchanged to a ``readStream`` DataFrame. A file-source stream with an
``availableNow`` trigger processes whatever has landed and stops; with a
processing-time trigger the same query runs continuously. Progress and
exactly-once file output come from the checkpoint folder, which lives under
the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import normalize as N
from ..operators import scoring as S
from ..session import ensure_checkpoint_dir


def read_loan_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(stream: DataFrame, models=None, normalize: bool = False) -> DataFrame:
    """Normalise (optional) and score a stream of loans, row by row."""
    df = N.normalize_loans(stream) if normalize else stream
    return S.score_loans(df, models)


def run_available_now(df: DataFrame, out_path: str, checkpoint: str | None = None, fmt: str = "parquet") -> str:
    """Write a streaming DataFrame with an availableNow trigger and wait."""
    spark = df.sparkSession
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), f"stream-ckpt-{uuid.uuid4().hex[:12]}")
    q = (df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
