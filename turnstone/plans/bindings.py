"""How the driver's tables stand in for message tables, in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Invented replies and questions, dealt over turns so that every rule branch is met.
PHRASES = (
    "Hi there, please DM us your booking reference and we will check. ^KC", "I want a refund for my ticket, this is ridiculous", "You can claim delay repay on our website https://t.co/abc1 ^JB",
    "We have cancelled your booking and changed your seat for today.", "Thanks, that worked. All sorted now, brilliant!", "Have you tried restarting the app or using a different browser?",
    "Which train are you on and what is your seat number please?", "I will pass this on to the station team, thanks for letting us know.", "This has been raised with customer relations, they will be in touch. ^AL",
    "My train is delayed again and the wifi is not working", "You're welcome, have a great day!", "The service is run by @55555, please contact them about it",
    "How do I log in? I forgot my password", "Still no answer, worst service ever", "The 10:45 from London to York will call at platform 3 this afternoon.",
    "I was charged £12.50 twice on Monday, can you help?", "Our team will look at it and report this to the manager.", "Sorry to hear that, could you send us a photo of the ticket?",
    "Where is my order? The parcel should have arrived", "Glad we could help, take care.", "Please provide your email address and phone number", "Ok thanks", "I love the new trains, thank you so much",
    "Seats in coach B can be reserved for £5.00 at any ticket office.",
)
_SQL_PHRASES = ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(PHRASES))

#: DuckDB: the common table expression `turns`, the same rows as turns().
TURNS = f"""phrases(pid, phrase) AS (VALUES {_SQL_PHRASES}),
turns AS (
  SELECT conv_id, turn, conv_id * 100 + turn AS tweet_id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent,
         CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'brand_agent' ELSE 'other_agent' END AS role,
         CASE role WHEN 'user' THEN (conv_id * 10 + CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END)::VARCHAR WHEN 'assistant' THEN 'acme' ELSE 'ops' || (conv_id % 3)::VARCHAR END AS author_id,
         role = 'user' AS inbound,
         CASE WHEN (conv_id * 3 + turn) % 17 = 0 THEN NULL ELSE 1704067200 + conv_id * 3600 + turn * 36000 + ((conv_id * 7 + turn * 13) % 40) * 3600 END AS ts,
         phrase AS text
  FROM conversations JOIN phrases ON pid = (conv_id * 31 + turn * 7) % 24
)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: ids, parents, roles, authors, times (some missing) and phrases."""
    c, t = F.col("conv_id"), F.col("turn")
    role = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "brand_agent").otherwise("other_agent")
    author = F.when(F.col("role") == "user", (c * 10 + F.when(t % 5 == 4, 1).otherwise(0)).cast("string")).when(F.col("role") == "assistant", "acme").otherwise(F.concat(F.lit("ops"), (c % 3).cast("string")))
    ts = F.when((c * 3 + t) % 17 != 0, 1704067200 + c * 3600 + t * 36000 + ((c * 7 + t * 13) % 40) * 3600)
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((c * 31 + t * 7) % len(PHRASES) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(
        c, t, (c * 100 + t).alias("tweet_id"), F.when(t > 0, c * 100 + t - 1).alias("parent"), role.alias("role"), author.alias("author_id"), (F.col("role") == "user").alias("inbound"),
        ts.alias("ts"), F.timestamp_seconds(ts).alias("created_at"), phrase.alias("text"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns() in the shape of cleaned messages."""
    kids = F.when(F.col("turn") % 2 == 0, F.array(F.col("tweet_id") + 1)).otherwise(F.array().cast("array<bigint>"))
    up = F.when(F.col("turn") % 2 == 0, F.col("parent"))  # odd turns are linked by the parent's list only
    return turns(spark, sf_dir).select("tweet_id", "author_id", "inbound", "created_at", "text", kids.alias("response_tweet_ids"), up.alias("in_response_to_tweet_id"), F.col("tweet_id").alias("source_row"), "role", "conv_id")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns() with thread columns, taking conv_id as the thread."""
    t = turns(spark, sf_dir)
    return t.select("tweet_id", "author_id", "inbound", "role", "created_at", "text", F.col("parent").alias("parent_tweet_id"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("conversation_id"), "ts")
