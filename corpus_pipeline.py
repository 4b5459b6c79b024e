"""A training-data pipeline over the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents it keeps. run() applies them in order; each result is written as Parquet to the
folder that the cluster shares and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import blocks, bpe, mixing, quality, simhash, substrings
from turnstone.llm.queries import vocabulary


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run's rows with just the columns of docs; further columns, whatever their names, pass through unseen."""
    return blocks.shielded(docs, COLUMNS, (), lambda d: run(d).select(*d.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the adaptive thresholds reject go.

    Null and empty texts have no words and go; null lang and source are groups of their own;
    repeated rows are judged alike; an empty table stays empty.
    """
    return _stage(docs, lambda d: quality.quality_rules(d).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Groups are those of operator 10 (3-word shingles, 2 bits). Of rows with equal doc_id and
    fingerprint the one with the smallest text stays, a null text first; null ids come last;
    null and empty texts are one group; an empty table stays empty.
    """
    return _stage(docs, simhash.one_of_each)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also stand earlier go; the document stays.

    n_chars follows the text where words were removed, and stays as it is elsewhere. Null and
    empty texts and texts of fewer than 20 words stay as they are; an empty table stays empty.
    """
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _stage(docs, lambda d: substrings.remove_repeats(d).withColumn("n_chars", n_chars))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same weight; documents repeat or go to meet it.

    A null source is a source; rows with equal doc_id get the same count; texts, null or not,
    play no part; an empty table stays empty.
    """
    return _stage(docs, mixing.mixed)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to.

    Null texts are encoded as empty ones, which have no ids; rows that mixing repeated are
    encoded each; an empty table stays empty; further columns end here.
    """
    only = docs.select(*[blocks.col(c) for c in ("doc_id", "text", "source")])
    return bpe.encoded(only, vocabulary(), decoded=False).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the sketches, fingerprints and the tokenizer; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's rows are removed when the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{blocks.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            blocks.remove(spark, before)
        before = f"{folder}/{name}"
    return docs
