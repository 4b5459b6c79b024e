"""Keyed state in streams: label states by case, and episodes with owners and agent-only tails.

Both keep a small state per key in Spark's state store, so a batch costs what its rows cost,
and both put out a row whenever a key changes; the last version of a row counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---- labels ----

LABEL = "case_id string, value string, saves long, drafted string, seq long"


def _folded(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The label of a case after more of its log: what labels.folded() does for tables."""
    value, saves, drafted, seq = state.get if state.exists else (None, 0, None, None)
    rows = sorted((int(s), a, None if pd.isna(v) else v) for f in frames for s, a, v in zip(f["seq"], f["action"], f["value"]))
    changed = False
    for s, action, v in rows:
        if seq is not None and s <= seq:  # seen before
            continue
        seq, changed = s, True
        if action == "clear":
            value, saves, drafted = None, 0, None
        else:
            value, saves, drafted = v, saves + (action != "draft"), v if action == "draft" else drafted
    state.update((value, saves, drafted, seq))
    if changed:
        yield pd.DataFrame({"case_id": [key[0]], "value": [value], "saves": [saves], "drafted": [drafted], "seq": [seq]})


def label_changes(events: DataFrame) -> DataFrame:
    """LABEL rows of the cases that a batch of an event log (case_id, seq, action, value) changes; events of a case come in order of seq, repeats are ignored."""
    own = events.select(F.col("case_id").cast("string").alias("case_id"), F.col("seq").cast("long").alias("seq"), "action", F.col("value").cast("string").alias("value"))
    return own.groupBy("case_id").applyInPandasWithState(_folded, LABEL, "value string, saves long, drafted string, seq long", "update", GroupStateTimeout.NoTimeout)


def label_log(events: DataFrame, path: str, checkpoint: str):
    """Writes the changed labels of each batch under path/version=<batch>: a batch that runs again overwrites its own rows, and none reads another's."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return label_changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def label_state(spark: SparkSession, path: str) -> DataFrame:
    """LABEL: the last version of each case, combined on the map side."""
    rows = spark.read.schema(f"{LABEL}, version long").option("basePath", path).parquet(path)
    fields = ["value", "saves", "drafted", "seq"]
    last = rows.groupBy("case_id").agg(F.max_by(F.struct(*fields), F.struct("seq", "version")).alias("s"))
    return last.select("case_id", *[F.col(f"s.{f}") for f in fields])


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """One version that has what all versions of path have, for a folder of its own: readers of a long log may change over to it."""
    label_state(spark, path).write.parquet(f"{to}/version=0")


# ---- episodes ----

EPISODE = "conversation_id string, owner_id string, episode int, first timestamp, last timestamp, n long, version long"
_STATE = "closed string, waiting string, told string, version long"


def _episodes(gap_us: int):
    """The fold of one owner's messages in a conversation.

    Messages wait until the watermark has passed them, so they are taken in order of time. A
    gap starts a segment; a segment without a customer's message joins the episode before it, as
    in batch, but only its end shows that it has none: till then it counts as a tail and may
    become an episode later. Kept are the last episode and the open segment, never older ones.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, waiting, told, version = state.get if state.exists else ("[]", "[]", "[]", 0)
        parts, queue, told = json.loads(closed), json.loads(waiting), json.loads(told)
        if not state.hasTimedOut:
            for f in frames:
                queue += [[int(t.value // 1000), int(i), bool(c)] for t, i, c in zip(f["created_at"], f["tweet_id"], f["customer"])]
        mark = state.getCurrentWatermarkMs() * 1000
        queue.sort()
        ready = [q for q in queue if q[0] < mark]
        queue = queue[len(ready) :]
        final = []  # parts: [episode, first, last, n, has a customer]; the first is the last episode, the second the open segment
        for time, _, customer in ready:
            if parts and time - parts[-1][2] <= gap_us:
                parts[-1][2], parts[-1][3], parts[-1][4] = time, parts[-1][3] + 1, parts[-1][4] or customer
                continue
            if len(parts) == 2:  # the open segment has ended
                before, ended = parts
                if ended[4]:
                    final.append(before)
                    parts = [ended]
                else:
                    parts = [[before[0], before[1], ended[2], before[3] + ended[3], before[4]]]
            parts.append([parts[-1][0] + 1 if parts else 0, time, time, 1, customer])
        now = list(parts)
        if len(now) == 2 and not now[1][4]:  # a tail so far
            now = [[now[0][0], now[0][1], now[1][2], now[0][3] + now[1][3], True]]
        said = [p[:4] for p in (*final, *now)]
        news = [p for p in said if p not in told]
        version += bool(news)
        state.update((json.dumps(parts), json.dumps(queue), json.dumps([p for p in said if p[0] >= said[-1][0] - 1] if said else told), version))
        if queue:
            state.setTimeoutTimestamp(max(queue[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if news:
            at = lambda us: pd.Timestamp(us, unit="us", tz="UTC").tz_localize(None)
            yield pd.DataFrame([(key[0], key[1], e, at(a), at(b), n, version) for e, a, b, n in news], columns=["conversation_id", "owner_id", "episode", "first", "last", "n", "version"])

    return fold


def episode_changes(messages: DataFrame, gap_hours: float = 24.0, late: str = "48 hours") -> DataFrame:
    """EPISODE rows of the episodes that change, from a stream (conversation_id, owner_id, tweet_id, created_at, role).

    Messages may come in any order within the watermark; later ones are dropped. The session time
    zone must be UTC.
    """
    rows = messages.where(F.col("created_at").isNotNull() & F.col("owner_id").isNotNull()).withWatermark("created_at", late)
    own = rows.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("owner_id").cast("string").alias("owner_id"), F.col("tweet_id").cast("long").alias("tweet_id"), "created_at", (F.col("role") == "customer").alias("customer"))
    return own.groupBy("conversation_id", "owner_id").applyInPandasWithState(_episodes(int(gap_hours * 3_600_000_000)), EPISODE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest_episodes(changes: DataFrame) -> DataFrame:
    """The last version of each episode among all changes put out so far."""
    w = Window.partitionBy("conversation_id", "owner_id", "episode").orderBy(F.desc("version"))  # a row a change of one episode
    last = changes.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return last
