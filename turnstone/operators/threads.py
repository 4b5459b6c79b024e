"""Reply threads: parents, components, turn order, roles, brand selection, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.operators import graph

#: Sign-off of agents who share an account: "^KC" at the end.
AGENT_SIGN = r"\^[A-Za-z]{2,3}\s*$"


def links(messages: DataFrame) -> DataFrame:
    """child, parent, listed, source_row of the parent side: all reply links, from both ends, that resolve."""
    ids = messages.select(F.col("tweet_id").alias("id"))
    up = messages.where("in_response_to_tweet_id is not null and in_response_to_tweet_id <> tweet_id").select(F.col("tweet_id").alias("child"), F.col("in_response_to_tweet_id").alias("parent"), F.lit(False).alias("listed"), F.lit(-1).cast("long").alias("row"))
    down = messages.select(F.col("tweet_id").alias("parent"), F.col("source_row").alias("row"), F.explode("response_tweet_ids").alias("child")).where("child <> parent").select("child", "parent", F.lit(True).alias("listed"), "row")
    up = up.join(ids, F.col("parent") == F.col("id"), "left_semi")
    down = down.join(ids, F.col("child") == F.col("id"), "left_semi")
    return up.unionByName(down)


def reconstructed(messages: DataFrame) -> DataFrame:
    """messages with conversation_id, root_tweet_id, parent_tweet_id, parent_source, missing_parent, turn_index, conversation_size."""
    found = graph.saved(links(messages))
    # The explicit reply id if it resolves; else the lister with the lowest file position.
    parent = found.groupBy("child").agg(F.min_by(F.struct("parent", "listed"), F.struct("listed", "row", "parent")).alias("p")).select(F.col("child").alias("tweet_id"), F.col("p.parent").alias("parent_tweet_id"), F.when(F.col("p.listed"), "response_list").otherwise("in_response_to").alias("parent_source"))
    group = graph.components(found.select(F.col("child").alias("a"), F.col("parent").alias("b")), messages.select(F.col("tweet_id").alias("node"))).withColumnRenamed("node", "tweet_id")
    known = messages.select(F.col("tweet_id").alias("in_response_to_tweet_id"), F.lit(True).alias("__known"))
    rows = messages.join(group, "tweet_id").join(parent, "tweet_id", "left").join(known, "in_response_to_tweet_id", "left")
    rows = rows.withColumn("missing_parent", F.col("in_response_to_tweet_id").isNotNull() & (F.col("in_response_to_tweet_id") != F.col("tweet_id")) & F.col("__known").isNull())
    return numbered(rows.drop("__known"), "root").drop("root")


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """root_tweet_id, conversation_id, turn_index and conversation_size by time (nulls last), then id."""
    w = Window.partitionBy(group)
    order = w.orderBy(F.asc_nulls_last("created_at"), "tweet_id")
    rows = rows.withColumns({"turn_index": F.row_number().over(order) - 1, "root_tweet_id": F.first("tweet_id").over(order), "conversation_size": F.count("*").over(w)})
    return rows.withColumn("conversation_id", F.concat(F.lit("conv_"), F.col("root_tweet_id").cast("string")))


def reconstruction_stats(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """One row: messages, threads, links, dangling list entries, missing parents, largest thread."""
    ids = messages.select(F.col("tweet_id").alias("id"))
    listed = messages.select(F.explode("response_tweet_ids").alias("child"))
    dangling = listed.join(ids, F.col("child") == F.col("id"), "left_anti").agg(F.count("*").alias("dangling"))
    sizes = threads.agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("threads"), F.count("parent_tweet_id").alias("with_parent"), F.count_if("missing_parent").alias("missing_parents"), F.max("conversation_size").alias("largest"))
    return sizes.crossJoin(F.broadcast(dangling))  # one row each


def brand_threads(threads: DataFrame, brand: str, thread: str = "conversation_id") -> DataFrame:
    """Whole threads: the brand wrote in them, or nobody but customers did and one mentions the brand."""
    named = F.rlike(F.lower("text"), F.lit(rf"(?U)@{brand.lower()}\b"))
    per = threads.groupBy(thread).agg(F.bool_or(F.lower("author_id") == brand.lower()).alias("wrote"), F.bool_or(~F.col("inbound")).alias("out"), F.bool_or(F.col("inbound") & named).alias("named"))
    return threads.join(per.where("wrote or (not out and named)").select(thread), thread, "left_semi")


def hidden_agents(rows: DataFrame, min_messages: int = 5, min_rate: float = 0.6) -> DataFrame:
    """author_id, n, rate of inbound authors whose messages mostly end with an agent's sign-off."""
    rate = F.avg(F.rlike("text", F.lit(AGENT_SIGN)).cast("int"))
    return rows.where("inbound").groupBy("author_id").agg(F.count("*").alias("n"), rate.alias("rate")).where((F.col("n") >= min_messages) & (F.col("rate") >= min_rate))


def with_roles(rows: DataFrame, brand: str, hidden: DataFrame) -> DataFrame:
    """role: brand_agent (exact name), other_agent (outbound or hidden), customer."""
    mark = hidden.select(F.col("author_id").alias("__h")).distinct()
    role = F.when(F.col("author_id") == brand, "brand_agent").when(~F.col("inbound") | F.col("__h").isNotNull(), "other_agent").otherwise("customer")
    return rows.join(mark, F.col("author_id") == F.col("__h"), "left").withColumn("role", role).drop("__h")


def orphan_links(rows: DataFrame, max_minutes: float = 120.0, order: Column | None = None) -> DataFrame:
    """tweet_id, target of single-message threads: an as-of join on the mentioned or mentioning party.

    A customer's orphan goes to the latest agent message before it that mentions them, an
    agent's orphan to the latest earlier message of the first mentioned customer who has one.
    order: what makes a message the latest of those within reach; its time, then its id, by default.
    Time is cut into blocks as long as the reach, so the messages within reach are the end of one
    block and the beginning of the next; running maxima of both are the as-of join: no pairs are
    formed, and a party with very many messages is worked on block by block.
    """
    agent = F.col("role") != "customer"
    named = F.array_distinct(X.mentions(F.col("text"), digits=True))
    rows = rows.withColumn("__order", F.struct("created_at", "tweet_id") if order is None else order)
    said = rows.where(agent).select("tweet_id", "created_at", "__order", F.explode(named).alias("party"), F.lit("agent").alias("kind"))
    spoke = rows.where(~agent).select("tweet_id", "created_at", "__order", F.col("author_id").cast("string").alias("party"), F.lit("customer").alias("kind"))
    asks = rows.where("conversation_size = 1 and created_at is not null")
    ask_c = asks.where(~agent).select("tweet_id", "created_at", F.col("author_id").cast("string").alias("party"), F.lit(0).alias("place"), F.lit("agent").alias("kind"))
    ask_a = asks.where(agent).select("tweet_id", "created_at", F.posexplode(X.mentions(F.col("text"), digits=True)).alias("place", "party")).withColumn("kind", F.lit("customer"))
    reach = int(max_minutes * 60_000_000)
    block = lambda t: F.floor(t / F.lit(reach + 1)).cast("long")
    at = F.unix_micros("created_at")
    # The earliest time within reach is asked for only if it lies in the block before.
    probes = F.array_compact(F.array(F.struct(at.alias("at"), F.lit(False).alias("back")), F.when(block(at - reach) < block(at), F.struct((at - reach).alias("at"), F.lit(True).alias("back")))))
    given = said.unionByName(spoke).where("created_at is not null").select("party", "kind", at.alias("at"), F.struct("__order", "tweet_id").alias("give"), F.lit(None).cast("long").alias("tweet_id"), F.lit(-1).alias("place"), F.lit(False).alias("back"))
    asked = ask_c.unionByName(ask_a).select("tweet_id", "party", "kind", "place", F.explode(probes).alias("p"))
    events = given.unionByName(asked.select("party", "kind", "p.at", F.lit(None).cast(given.schema["give"].dataType).alias("give"), F.col("tweet_id").cast("long").alias("tweet_id"), "place", "p.back")).withColumn("block", block(F.col("at")))
    # Candidates of the same time count, whatever their id: range frames up to or from the current time.
    by = Window.partitionBy("party", "kind", "block")
    until, since = (by.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("at"), F.desc("at")))
    near = events.withColumns({"until": F.max("give").over(until), "since": F.max("give").over(since)}).where("place >= 0")
    best = near.groupBy("tweet_id", "place").agg(F.max(F.when(F.col("back"), F.col("since")).otherwise(F.col("until"))).alias("best"))
    return best.where("best.tweet_id <> tweet_id").groupBy("tweet_id").agg(F.min_by("best.tweet_id", "place").alias("target"))


def orphans_linked(rows: DataFrame, max_minutes: float = 120.0) -> DataFrame:
    """rows with orphans moved to their target's thread; chains of orphans end in the same thread."""
    link = graph.saved(orphan_links(rows, max_minutes))
    top = graph.ancestors(rows.select(F.col("tweet_id").alias("node")).join(link.select(F.col("tweet_id").alias("node"), F.col("target").alias("parent")), "node", "left")).select(F.col("node").alias("tweet_id"), "top")
    home = rows.select(F.col("tweet_id").alias("top"), F.col("root_tweet_id").alias("__root"))
    moved = rows.join(top, "tweet_id").join(home, "top").join(link, "tweet_id", "left")
    parent = {"parent_tweet_id": F.coalesce("target", "parent_tweet_id"), "parent_source": F.when(F.col("target").isNotNull(), "contextual_mention").otherwise(F.col("parent_source"))}
    return numbered(moved.withColumns(parent).drop("top", "target", "root_tweet_id", "conversation_id", "turn_index", "conversation_size"), "__root").drop("__root")
