"""Cluster reports for a taxonomy: reply patterns, mixes, neighbours, cached predictions, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as X


def reply_patterns(first_replies: DataFrame, by: str, text: str, least: int = 3, top: int = 5) -> DataFrame:
    """by, template, n, example: the commonest 6-token templates of a group with their commonest wording."""
    t = first_replies.select(by, F.col(text).alias("raw"), X.template_key(F.col(text), 6).alias("template")).where("template <> ''")
    wording = t.groupBy(by, "template", "raw").agg(F.count("*").alias("k"))
    per = wording.groupBy(by, "template").agg(F.sum("k").alias("n"), F.min_by("raw", F.struct(-F.col("k"), "raw")).alias("example")).where(F.col("n") >= least)
    return per.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "template"))).where(F.col("place") <= top)


def cluster_report(rows: DataFrame, cluster: str, margin: str, second: str, kind: str, head: int = 3) -> DataFrame:
    """cluster, n, mean_margin, low_margin (its 25 % quantile), mix (top kinds with shares), neighbours (second clusters of low-margin rows)."""
    flat = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.round(F.avg(margin), 4).alias("mean_margin"), F.percentile(margin, 0.25).alias("low_margin"))

    def shares(df: DataFrame, label: str, to: str, k: int) -> DataFrame:
        w = Window.partitionBy(cluster)
        c = df.groupBy(cluster, label).agg(F.count("*").alias("c")).withColumns({"share": F.col("c") / F.sum("c").over(w), "place": F.row_number().over(w.orderBy(F.desc("c"), label))}).where(F.col("place") <= k)
        items = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col(label).cast("string"), F.round("share", 3).cast("string")).alias("s"))))  # at most k a cluster
        return c.groupBy(cluster).agg(F.array_join(F.transform(items, lambda x: x["s"]), ",").alias(to))

    low = rows.join(flat.select(cluster, "low_margin"), cluster).where(F.col(margin) <= F.col("low_margin"))
    return flat.join(shares(rows, kind, "mix", 6), cluster, "left").join(shares(low, second, "neighbours", head), cluster, "left")


def known_confusable(neighbours: DataFrame, intent: str = "intent", other: str = "other", share: str = "share", size: str = "size", top: int = 4) -> DataFrame:
    """intent, other, weight, place: runner-up intents by share weighted with cluster size."""
    w = Window.partitionBy(intent)
    total = neighbours.select(intent, "cluster", size).distinct().groupBy(intent).agg(F.sum(size).alias("__total"))
    got = neighbours.where(F.col(other) != F.col(intent)).groupBy(intent, other).agg(F.sum(F.col(share) * F.col(size)).alias("__x")).join(total, intent)
    got = got.select(intent, other, F.round(F.col("__x") / F.col("__total"), 6).alias("weight"))
    return got.withColumn("place", F.row_number().over(w.orderBy(F.desc("weight"), other))).where(F.col("place") <= top)


def margin_percentile(margin: str, by: str) -> Column:
    """The share of a group's rows with at most this margin."""
    return F.cume_dist().over(Window.partitionBy(by).orderBy(margin))


def with_cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """requests with what the cache has for their keys; to_score marks the rest."""
    return requests.join(cache.withColumn("__hit", F.lit(True)), keys, "left").withColumn("to_score", F.col("__hit").isNull()).drop("__hit")


def request_key(*parts: Column) -> Column:
    """The key of a model request: SHA-256 of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def hashed_vector(tokens: Column, size: int = 64) -> Column:
    """A signed hashed bag of words of unit length: an encoder that needs no model."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")
    sign = lambda t: F.when(F.pmod(F.shiftright(F.xxhash64(t), 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    add = lambda acc, t: F.transform(acc, lambda x, i: F.when(i == place(t), x + sign(t)).otherwise(x))
    unit = lambda acc: F.transform(acc, lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(acc, F.lit(0.0), lambda a, y: a + y * y))), F.lit(0.0)))
    return F.aggregate(tokens, F.array_repeat(F.lit(0.0), size), add, unit)
