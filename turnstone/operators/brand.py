"""One brand from cleaned messages to cases, as one plan, and its three output tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import values as V
from turnstone.operators import episodes as E
from turnstone.operators import graph
from turnstone.operators import threads as TH
from turnstone.sources.tables import write_parquet


class Brand(NamedTuple):
    """messages with thread, role, owner and episode columns; cases; threads; authors found to be agents."""

    messages: DataFrame
    cases: DataFrame
    conversations: DataFrame
    hidden: DataFrame


def built(messages: DataFrame | None, brand: str, *, threads: DataFrame | None = None, more_operators: tuple[str, ...] = (), gap_hours: float = 24.0, orphan_minutes: float = 120.0, keep: bool = True) -> Brand:
    """Threads of a brand, roles, orphans, episodes and cases, from cleaned messages or from reconstructed threads.

    Handles of other operators are those of hidden agents, of other agents in the threads and more_operators;
    they are as many as there are agents, so the rule that looks for them gets them as a list.
    keep: cases are saved whole, to be read several times; else each use works out the columns it reads.
    """
    if messages is None and threads is None:
        raise ValueError("give cleaned messages or reconstructed threads")
    rows = threads if threads is not None else TH.reconstructed(messages)
    mine = graph.saved(TH.brand_threads(rows, brand))
    hidden = graph.saved(TH.hidden_agents(mine))
    linked = TH.orphans_linked(TH.with_roles(mine, brand, hidden), orphan_minutes)
    every = graph.saved(E.segmented(linked, gap_hours))
    others = every.where("role = 'other_agent'").select(F.col("author_id").cast("string").alias("a")).union(hidden.select(F.col("author_id").cast("string"))).distinct()
    names = sorted({*more_operators, *[r["a"] for r in others.collect()]})  # one row an agent
    cases = E.case_table(every, operators=names).join(E.context_ids(every), "case_id")
    per = every.where("case_id is not null").groupBy("case_id").agg(
        F.first("conversation_id").alias("conversation_id"), F.first("owner_id").alias("customer_id"), F.first("episode_seq").alias("episode_seq"), F.first("continues_case_id").alias("continues_case_id"),
        F.array_sort(F.collect_list("tweet_id")).alias("source_tweet_ids"),
    )
    cases = cases.join(per, "case_id").withColumns({"brand": F.lit(brand), "is_continuation": F.col("continues_case_id").isNotNull()})
    cases = graph.saved(cases) if keep else cases
    # from the messages, not from cases: what reads few columns of cases does not look for signals in their texts
    spans = every.where("case_id is not null").groupBy("case_id").agg(F.first("owner_id").alias("customer_id"), F.min("created_at").alias("first_timestamp"), F.max("created_at").alias("last_timestamp"))
    related = E.related_cases(graph.saved(spans), gap_hours)
    return Brand(every, cases.join(related, "case_id"), conversation_table(every, brand), hidden)


def conversation_table(rows: DataFrame, brand: str) -> DataFrame:
    """One row a thread: its turns in order, customers and other agents in order of appearance, cases, span, largest gap, whether a parent is missing."""
    w = Window.partitionBy("conversation_id").orderBy(F.asc_nulls_last("created_at"), "tweet_id")
    gaps = rows.withColumn("__gap", V.hours_between(F.lag("created_at").over(w), F.col("created_at")))
    missing = F.bool_or("missing_parent") if "missing_parent" in rows.columns else F.lit(False)
    order = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "tweet_id")
    first = F.min(order)
    flat = gaps.groupBy("conversation_id").agg(
        F.count("*").alias("tweet_count"), F.min("created_at").alias("first_timestamp"), F.max("created_at").alias("last_timestamp"), F.max("__gap").alias("max_gap_hours"), missing.alias("has_missing_parent"),
        F.min_by("tweet_id", order).alias("root_tweet_id"),
    )

    def seen(column: str, condition: str, to: str) -> DataFrame:
        """Distinct values in order of first appearance; a value of a busy thread is one entry, not one a message."""
        each = rows.where(condition).groupBy("conversation_id", F.col(column).cast("string").alias("x")).agg(first.alias("at"))
        return each.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(to))

    out = flat.join(E.turns_of(rows, "conversation_id"), "conversation_id")
    none = F.array().cast("array<string>")
    for column, condition, to in (("author_id", "role = 'customer'", "customer_ids"), ("author_id", "role = 'other_agent'", "other_agent_ids"), ("case_id", "case_id is not null", "case_ids")):
        out = out.join(seen(column, condition, to), "conversation_id", "left").withColumn(to, F.coalesce(to, none))
    return out.withColumn("brand", F.lit(brand))


def write_outputs(result: Brand, path: str, prefix: str) -> dict[str, str]:
    """The three tables as zstd Parquet; gives the path of each."""
    paths = {name: f"{path}/{prefix}_{name}" for name in ("conversations", "tweets", "cases")}
    write_parquet(result.conversations, paths["conversations"])
    write_parquet(result.messages, paths["tweets"])
    write_parquet(result.cases, paths["cases"])
    return paths


def write_support_cases(cases: DataFrame, path: str, brands: list[str] | None = None, jsonl: bool = False) -> dict[str, int]:
    """Cases of the named brands (all, if none are named) as zstd Parquet or gzip JSON lines; gives the number of cases of each brand."""
    kept = cases.where(F.col("brand").isin(*brands)) if brands else cases
    writer = kept.write.mode("error")
    writer.option("compression", "gzip").json(path) if jsonl else writer.options(compression="zstd", maxRecordsPerFile=50_000).parquet(path)
    spark = cases.sparkSession
    back = spark.read.json(path) if jsonl else spark.read.parquet(path)
    return {r["brand"]: r["n"] for r in back.groupBy("brand").agg(F.count("*").alias("n")).collect()}  # one row a brand
