"""Profiles: what a message table holds, and what the cases of a brand look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import values as V


def _long(one: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """A one-row table as section, name, value."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")


def dataset_profile(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """section, name, value: messages, relationships (percent, 2 digits), conversations, size histogram (10 for more) and messages per brand.

    messages are cleaned ones, threads the same ones reconstructed.
    """
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    up, kids = F.col("in_response_to_tweet_id").isNotNull(), F.size("response_tweet_ids")
    inbound, outbound = F.count_if("inbound"), F.count_if(~F.col("inbound"))
    m = messages.agg(
        F.count("*").alias("total_tweets"), F.count_distinct("author_id").alias("unique_authors"), F.count_distinct(F.when(~F.col("inbound"), F.col("author_id"))).alias("unique_brands"), inbound.alias("inbound_tweets"), outbound.alias("outbound_tweets"),
        F.round(inbound / F.greatest(outbound, F.lit(1)), 4).alias("inbound_outbound_ratio"), F.unix_seconds(F.min("created_at")).alias("first_second"), F.unix_seconds(F.max("created_at")).alias("last_second"),
        pct(up).alias("pct_with_in_response_to"), pct(kids > 0).alias("pct_with_response_tweet_id"), pct(up | (kids > 0)).alias("pct_with_any_relationship"), pct(kids > 1).alias("pct_with_multiple_responses"),
    )
    sizes = threads.groupBy("conversation_id").agg(F.count("*").alias("n"), (F.bool_or("inbound") & F.bool_or(~F.col("inbound"))).alias("both"))
    at = lambda p: F.percentile("n", p)
    c = sizes.agg(
        F.count("*").alias("count"), F.count_if(F.col("n") == 1).alias("single_tweet"), F.round(100 * F.avg((F.col("n") == 1).cast("int")), 2).alias("pct_single_tweet"), F.count_if("both").alias("with_customer_and_brand"),
        F.round(F.avg("n"), 3).alias("size_mean"), at(0.5).alias("size_median"), at(0.9).alias("size_p90"), at(0.99).alias("size_p99"), F.max("n").alias("size_max"),
    )
    histogram = sizes.groupBy(F.least("n", F.lit(10)).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("sizes").alias("section"), "name", "value")
    brands = messages.where(~F.col("inbound")).groupBy(F.col("author_id").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("brand").alias("section"), "name", "value")
    related = [x for x in m.columns if x.startswith("pct")]
    return _long(m, "messages", [x for x in m.columns if x not in related]).unionByName(_long(m, "relationships", related)).unionByName(_long(c, "conversations", c.columns)).unionByName(histogram).unionByName(brands)


def shares(cases: DataFrame, by: str | Column, section: str) -> DataFrame:
    """section, name, n, share: how rows spread over the values of by."""
    c = cases.groupBy((F.col(by) if isinstance(by, str) else by).cast("string").alias("name")).agg(F.count("*").alias("n"))
    return c.select(F.lit(section).alias("section"), "name", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def case_report(cases: DataFrame) -> DataFrame:
    """section, name, n, share: weekly volume, length buckets, resolution types and outcomes of cases."""
    parts = [shares(cases, V.week_label(F.col("first_timestamp")), "week"), shares(cases, "length_label", "length"), shares(cases, "resolution_type", "resolution"), shares(cases, "outcome", "outcome")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolution_table(cases: DataFrame) -> DataFrame:
    """One row a resolution type: cases, share, share resolved and moved to DM, median turns, median first response."""
    c = cases.groupBy("resolution_type").agg(
        F.count("*").alias("n"), F.avg(F.col("resolved").cast("int")).alias("resolved"), F.avg(F.col("dm_redirect").cast("int")).alias("dm"), F.percentile("turn_count", 0.5).alias("median_turns"), F.percentile("first_response_minutes", 0.5).alias("median_response_minutes")
    )
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
