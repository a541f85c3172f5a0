"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from paratope.llm import centroids, langid, license_scan, line_dedup, mixing, near_dedup, piece_codec, quality, runs, sstable, topk, url_filter, word_codec
from paratope.llm.common import table


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    files = documents.select(F.col("doc_id").alias("id"), license_scan.document_path(F.col("source"), F.col("doc_id")).alias("path"), "text")
    return license_scan.scan_licenses(files).withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sstable.new_folder(spark)
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return sstable.read_shards(spark, folder, shards)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.LEVEL[1])


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return runs.repeat_runs(documents, outputs=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def op12_word_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op1_near_dedup": op1_near_dedup, "op2_topk": op2_topk, "op3_language_id": op3_language_id, "op9_sstable": op9_sstable, "op10_piece_codec": op10_piece_codec, "op4_line_dedup": op4_line_dedup, "op5_license_scan": op5_license_scan, "op6_url_filter": op6_url_filter, "op7_mix_sources": op7_mix_sources, "op8_quality_rules": op8_quality_rules, "op11_elkan_clusters": op11_elkan_clusters, "op12_word_codec": op12_word_codec, "op13_repeat_runs": op13_repeat_runs}
ORACLES = {"op1_near_dedup": near_dedup.ORACLE, "op2_topk": topk.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op5_license_scan": license_scan.ORACLE, "op6_url_filter": url_filter.ORACLE, "op7_mix_sources": mixing.ORACLE, "op8_quality_rules": quality.ORACLE, "op11_elkan_clusters": centroids.ORACLE}
