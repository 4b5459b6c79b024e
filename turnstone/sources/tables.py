"""Message sources: declared schemas, reading, validation, cleaning, and plain writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import values as V

# ---- fixed values: the columns of a raw message table ----
RAW = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
NULLABLE = ("response_tweet_id", "in_response_to_tweet_id")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])


class SchemaError(ValueError):
    """A source lacks required columns."""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, only empty text is null, plus source_row in file order.

    source_row of a table in several files follows Spark's split order; within one file it is
    the row order. It is made without collecting rows or moving them to one task.
    """
    if path.endswith((".csv", ".csv.gz")):
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)
    elif path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"neither .csv, .csv.gz nor .parquet: {path}")
    text = raw.select([F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in raw.columns])
    return text.withColumn("source_row", F.monotonically_increasing_id())


def validate(raw: DataFrame) -> dict:
    """Raises SchemaError without the required columns; else counts what is odd, in one pass."""
    missing = [c for c in RAW if c not in raw.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in RAW if c not in NULLABLE]
    bad = F.count_if(~F.coalesce(F.lower(F.trim("inbound")).isin("true", "false"), F.lit(False))).alias("bad_inbound")
    ids = F.count_if(V.whole_number(F.col("tweet_id")).isNull()).alias("bad_tweet_id")
    report = raw.agg(F.count("*").alias("rows"), *counts, bad, ids).first().asDict()
    return report | {"extra_columns": sorted(set(raw.columns) - {*RAW, "source_row"})}


def deduplicated(rows: DataFrame, key: str = "tweet_id", order: str = "source_row", same: tuple[str, ...] = ("author_id", "inbound", "text", "created_at")) -> DataFrame:
    """The first row of each key by order, with n_exact and n_conflicting: its further rows, equal to it or not.

    Aggregates instead of ranking, so map tasks combine before the shuffle and a key with very
    many rows costs one row a task.
    """
    others = [c for c in rows.columns if c != key]
    value = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in same])
    per = rows.groupBy(key, value.alias("__v")).agg(F.count("*").alias("__n"), F.min_by(F.struct(*others), order).alias("__row"), F.min(order).alias("__at"))
    out = per.groupBy(key).agg(F.min_by("__row", "__at").alias("__row"), F.sum("__n").alias("__all"), F.sum(F.col("__n") - 1).alias("n_exact"))
    return out.select(key, *[F.col(f"__row.{c}").alias(c) for c in others], "n_exact", (F.col("__all") - 1 - F.col("n_exact")).alias("n_conflicting"))


def cleaned(raw: DataFrame) -> DataFrame:
    """Typed messages: bad ids and inbound values dropped, duplicates resolved, times and lists parsed."""
    inbound = F.lower(F.trim("inbound"))
    rows = raw.withColumns({"__id": V.whole_number(F.col("tweet_id")), "__in": inbound}).where(F.col("__id").isNotNull() & inbound.isin("true", "false"))
    kept = deduplicated(rows.withColumn("tweet_id", F.col("__id")).drop("__id"))
    parent = F.round(F.trim("in_response_to_tweet_id").try_cast("double")).cast("long")
    return kept.select(
        "tweet_id", "author_id", (F.col("__in") == "true").alias("inbound"), V.created_at(F.col("created_at")).alias("created_at"), F.coalesce("text", F.lit("")).alias("text"),
        V.id_list(F.col("response_tweet_id")).alias("response_tweet_ids"), F.coalesce(V.whole_number(F.col("in_response_to_tweet_id")), parent).alias("in_response_to_tweet_id"),
        F.col("created_at").alias("created_at_raw"), F.col("response_tweet_id").alias("response_tweet_id_raw"), "source_row",
    )


def cleaning_report(raw: DataFrame) -> DataFrame:
    """One row of what cleaning drops and cannot parse."""
    key = V.whole_number(F.col("tweet_id"))
    bad_flag = ~F.coalesce(F.lower(F.trim("inbound")).isin("true", "false"), F.lit(False))
    listed = F.coalesce(F.trim("response_tweet_id"), F.lit("")) != ""
    one = raw.agg(
        F.count("*").alias("rows_in"), F.count_if(key.isNull()).alias("bad_tweet_id"), F.count_if(key.isNotNull() & bad_flag).alias("bad_inbound"),
        F.count_if(F.col("created_at").isNotNull() & V.created_at(F.col("created_at")).isNull()).alias("bad_created_at"),
        F.count_if(listed & (F.size(V.id_list(F.col("response_tweet_id"))) == 0)).alias("bad_response_list"), F.count_if(F.col("text").isNull()).alias("null_text"),
    )
    kept = deduplicated(raw.withColumn("tweet_id", key).where(key.isNotNull() & ~bad_flag)).agg(F.coalesce(F.sum("n_exact"), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("n_conflicting"), F.lit(0)).alias("conflicting_duplicates"), F.count("*").alias("rows_out"))
    return one.crossJoin(F.broadcast(kept))  # one row each


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = read_raw(spark, path)
    validate(raw)
    return cleaned(raw)


def latest_records(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; records with an error are left out first."""
    if "error" in lines.columns:
        lines = lines.where("error is null")
    others = [c for c in lines.columns if c != key]
    return lines.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_parquet(df: DataFrame, path: str, *, by: str | None = None, rows_per_file: int = 1_000_000) -> None:
    writer = df.write.mode("error").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if key is unique in it; else ValueError (for one-to-one joins)."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def require_disjoint(df: DataFrame, other: DataFrame, key: str | Column = "case_id") -> DataFrame:
    """df, if it shares no key with other; else ValueError (leakage guard)."""
    if not df.join(other.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"rows share {key} with a set they must not touch")
    return df
