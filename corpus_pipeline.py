"""A training corpus from raw documents: classify, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanframe.llm import exact_dedup, mixing, packing, quality_classifier, simhash
from loanframe.llm.common import stored, table

TOKENIZER = "byte_bpe_50k.json"
BATCH_ROWS = 2_000  # rows of whole texts that a Python worker gets at a time


def _in_batches(spark: SparkSession) -> None:
    """Texts are long, so the Arrow batches of the stages that run Python are shorter than Spark's default of 10,000 rows:
    the buffers on both sides of a worker stay at a few MB. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _in_batches(spark)
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    _in_batches(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _in_batches(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in training sequences."""
    _in_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), special_as_text=False)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_documents),
]

ORACLE_SQL = None  # learned scores, XXH64 and token ids are beyond SQL; tests hold the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
