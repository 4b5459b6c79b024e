"""Structured Streaming forms of batch operators. Each keeps bounded state by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import labels


def deduplicated(messages: DataFrame, key: str = "tweet_id", time: str = "created_at", late: str = "2 hours") -> DataFrame:
    """The first message of each key within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def episodes(messages: DataFrame, owner: str, time: str, gap: str = "24 hours", late: str = "48 hours") -> DataFrame:
    """owner, first, last, n of inactivity episodes.

    A session window ends at last + gap, exclusive, so a message exactly a gap later opens a new
    one; batch segmentation splits only beyond the gap. One microsecond is added to agree.
    """
    w = F.session_window(time, f"{gap} 1 microsecond")
    out = messages.withWatermark(time, late).groupBy(w.alias("w"), owner).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    return out.select(owner, "first", "last", "n")


def weekly_volume(messages: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """week (its Monday) and n."""
    week = F.window(time, "7 days", startTime="4 days")  # the epoch was a Thursday
    return messages.withWatermark(time, late).groupBy(week.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "n")


STATE = "case_id string, value string, saves long, drafted string, seq long"


def label_upserts(events: DataFrame, path: str, checkpoint: str):
    """Keeps the labels of an event log (case_id, seq, action, value) as Parquet versions under path.

    Each batch folds its events into the state of the version before it and writes the next
    one, one row a case. Readers take label_state(); a batch that runs again overwrites its own version.
    """

    def write(batch: DataFrame, number: int) -> None:
        before = label_state(batch.sparkSession, path, before=number)
        own = batch.select(F.col("case_id").cast("string").alias("case_id"), "seq", "action", F.col("value").cast("string").alias("value"))
        labels.folded(before, own).write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def label_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The folded state of the last version (below before), or an empty one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in files.listStatus(place)] if files.exists(place) else []
    numbers = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("version=")) if before is None or n < before]
    return spark.read.schema(STATE).parquet(f"{path}/version={max(numbers)}") if numbers else spark.createDataFrame([], STATE)
