"""Split files with a manifest, and small configuration files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.sources.tables import write_parquet


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below the folder), bytes, sha256 of all files of a folder, each hashed where it is read.

    Spark reads a file whole for this, so files must be below 2 GB; what it writes is cut far below that.
    """
    root = path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = root.rsplit("/", 1)[-1]
    return found.select(F.substring_index("path", f"/{name}/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change (added, removed or changed) between two file_hashes(): what a run must not have touched, and did."""
    old, new = before.select("file", F.col("sha256").alias("old")), after.select("file", F.col("sha256").alias("new"))
    both = old.join(new, "file", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("file", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def write_splits(rows: DataFrame, path: str, split: str = "split", key: str = "case_id", reason: str | None = None) -> dict:
    """Parquet by split, so a reader of one split skips the others; the assignments as CSV (key, split, reason); and a manifest.

    The manifest has the rows of each split, an order-free digest of its keys, and the sha256 of
    every file written, so verified_splits() can tell whether any was changed.
    """
    write_parquet(rows, f"{path}/data", by=split)
    columns = [F.col(key).cast("string").alias("case_id"), F.col(split).alias("split"), (F.col(reason) if reason else F.lit("")).alias("reason")]
    rows.select(*columns).write.mode("error").option("header", True).csv(f"{path}/assignments")
    parts = rows.groupBy(split).agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64(key))).alias("digest")).collect()  # one row a split
    spark = rows.sparkSession
    files = {f"{folder}/{r.file}": r.sha256 for folder in ("data", "assignments") for r in file_hashes(spark, f"{path}/{folder}").collect()}  # one row a file
    manifest = {r[split]: {"rows": r["n"], "digest": r["digest"]} for r in parts}
    spark.createDataFrame([(json.dumps({"splits": manifest, "files": files}, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest")
    return manifest


def verified_splits(spark: SparkSession, path: str) -> list[str]:
    """The files of write_splits() that were added, removed or changed since; an empty list is intact."""
    said = spark.createDataFrame([(f, h) for f, h in read_manifest(spark, path, "files").items()], "file string, sha256 string")
    now = [file_hashes(spark, f"{path}/{folder}").withColumn("file", F.concat(F.lit(f"{folder}/"), "file")) for folder in ("data", "assignments")]
    return [f"{r.file}: {r.change}" for r in changed_files(said, now[0].unionByName(now[1])).orderBy("file").collect()]


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("case_id string, split string, reason string").option("header", True).csv(f"{path}/assignments")


def read_manifest(spark: SparkSession, path: str, part: str = "splits") -> dict:
    """part: splits (rows and digest of each) or files (sha256 of each)."""
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])[part]


def read_config(spark: SparkSession, path: str) -> dict:
    """A small YAML or JSON file, read through Spark so that any store works."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configuration needs PyYAML") from e
    return yaml.safe_load(text)
