"""Where outside models plug in: encoders and language models as batch functions, and caches so that no request runs twice."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import text as X
from turnstone.operators import graph
from turnstone.operators import taxonomy as TX


class Encoder(Protocol):
    """Adds an array<double> column of unit length to a table, in a plan: Columns or a vectorised function."""

    def __call__(self, rows: DataFrame, text: str, to: str) -> DataFrame: ...


class LanguageModel(Protocol):
    """Adds output and error (string) to a table of requests; what fails has an error and no output."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """query_id, case_id, score, rank of the k best cases of each query."""

    def __call__(self, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame: ...


def hashed_encoder(rows: DataFrame, text: str, to: str) -> DataFrame:
    """The encoder that needs no model: hashed terms."""
    return rows.withColumn(to, TX.hashed_vector(X.tokens(F.col(text))))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cache at path, or an empty one."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def embedded(rows: DataFrame, text: str, encoder: Encoder, path: str, model: str = "hashed", to: str = "vector") -> DataFrame:
    """rows with a vector of text: taken from the cache at path, made and stored once for texts not in it.

    The cache is keyed by model and text, so a text that a third of all rows have is encoded once.
    """
    key = F.sha2(F.concat_ws("\x1f", F.lit(model), F.coalesce(F.col(text), F.lit(""))), 256)
    keyed = rows.withColumn("__key", key)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    known = _stored(rows.sparkSession, path, schema)
    fresh = keyed.groupBy("__key").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("__text")).join(known.select(F.col("key").alias("__key")), "__key", "left_anti")
    encoder(fresh, "__text", "v").select(F.col("__key").alias("key"), F.col("v").cast("array<double>").alias("v")).write.mode("append").parquet(path)
    made = rows.sparkSession.read.schema(schema).parquet(path).groupBy("key").agg(F.any_value("v").alias(to))  # two runs at once may both have stored a text
    return keyed.join(made.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def answered(requests: DataFrame, model: LanguageModel, path: str, name: str, payload: Column | None = None) -> DataFrame:
    """requests (with payload) with output, error and cached: answers stored before, and those of the model, which are stored now.

    Only answers without an error are stored, so a run that failed half-way resumes with what is missing.
    """
    keyed = requests.withColumn("__key", TX.request_key(payload if payload is not None else F.col("payload"), F.lit(name)))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("output", T.StringType())])
    known = _stored(requests.sparkSession, path, schema).groupBy("key").agg(F.any_value("output").alias("output"))
    new = keyed.join(known.select(F.col("key").alias("__key")), "__key", "left_anti").dropDuplicates(["__key"])
    given = graph.saved(model(new).select(F.col("__key").alias("key"), "output", "error"))  # a request is sent once
    given.where("coalesce(error, '') = '' and output is not null").select("key", "output").write.mode("append").parquet(path)
    every = known.select("key", "output", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(given.select("key", "output", "error", F.lit(False).alias("cached")))
    return keyed.join(every.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def answered_stream(requests: DataFrame, model: LanguageModel, path: str, name: str, out: str, checkpoint: str):
    """answered() for a stream: each batch asks only for what no batch before it got an answer to."""

    def write(batch: DataFrame, number: int) -> None:
        answered(batch, model, path, name).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
