"""The queries of the subpackage over the given tables, and the SQL that some of them must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints, importance, jaccard_join, license_scan, line_dedup, packing, piece_codec, quality_rules, sharding, sql, token_counts,
    token_files, warc, whitening)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_documents(_table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), BYTE_BPE)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(_table(spark, folder, "documents"), BYTE_BPE)


def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.digests(_table(spark, folder, "documents"), PIECE_BPE)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_shared_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), BYTE_BPE)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(_table(spark, folder, "pages"))


def op11_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = _table(spark, folder, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.interleave(sized).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


queries = {f.__name__: f for f in (
    op1_document_fingerprints, op2_quality_rules, op3_best_fit_packing, op4_token_files, op5_piece_codec, op6_jaccard_join, op7_license_scan, op8_line_dedup, op9_token_counts, op10_warc,
    op11_interleaved_shards, op12_embedding_whitening, op13_importance_resampling)}
oracles = {"op6_jaccard_join": sql.JACCARD, "op2_quality_rules": sql.quality_rules(), "op8_line_dedup": sql.line_dedup("documents"), "op10_warc": sql.WARC,
           "op11_interleaved_shards": sql.INTERLEAVED, "op13_importance_resampling": sql.IMPORTANCE}
