"""Queries of this folder's operators over the driver tables, and SQL for some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, blocks, bpe, codes, extraction, hmm, licenses, mixing, neighbours, quality, secrets, sharding, simhash, substrings


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), 20, every=20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.hilbert_shards(_read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = blocks.saved(quality.with_counts(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text"))
    return quality.judged(counted, quality.thresholds(counted)).drop("lang", "source", "n_lines")


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, vocabulary(), ids=False, decoded=False).drop("text")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.found(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_license_scan": op4_license_scan,
    "op5_html_extraction": op5_html_extraction,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_hmm_scoring": op8_hmm_scoring,
    "op9_bpe": op9_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE.format(docs="documents"),
    "op2_substring_dedup": substrings.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op12_secret_scan": secrets.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
