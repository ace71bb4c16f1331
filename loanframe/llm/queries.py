"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from loanframe.llm import (best_fit, divergence, exact_dedup, html_text, merkle, mixing, packing, quality_classifier,
                           quality_rules, simhash, suffix_dedup, token_files, url_filter)
from loanframe.llm.common import folder, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), special_as_text=False)
    placed = packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         "offset", "padded_length")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "r.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_chars")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "r.page_id", "host", "path", "rule", "verdict")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("r.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.rated(docs).select("r.doc_id", "size", "source_size", "target",
                                     (F.col("size") * F.col("copies")).alias("taken"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), special_as_text=False)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.annotate(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("r.page_id", "r.url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = table(spark, sf_dir, "documents").select("doc_id", "text"), quality_classifier
    scored = c.score(docs, c.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("r.doc_id", c.held_out(F.col("r.doc_id")).alias("held_out"), "score",
                         (F.col("score") >= c.THRESHOLD).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.stream(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), special_as_text=False)
    placed = best_fit.settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = merkle.manifest(docs, claims={"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return told.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack_documents, op2_exact_dedup, op3_quality_rules, op4_url_filter, op5_suffix_dedup,
                              op6_mix_sources, op7_token_files, op8_simhash_dedup, op9_html_text, op10_quality_classifier,
                              op11_source_divergence, op12_best_fit_packing, op13_merkle_manifest)
}
