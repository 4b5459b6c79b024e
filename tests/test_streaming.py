"""Streams with keyed state against their batch forms."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from turnstone.operators import episodes as E
from turnstone.operators import labels as L
from turnstone.streaming import cases as ST

T0 = dt.datetime(2024, 1, 1)
MESSAGES = "conversation_id string, owner_id string, tweet_id long, created_at timestamp, role string"


def fed(spark, parts, schema, folder):
    """A stream that gets each part in a batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    files = sorted(Path(folder).glob("*/part-*.parquet"))
    flat = Path(folder + "-flat")
    flat.mkdir()
    for i, f in enumerate(files):
        target = flat / f"{i:03d}.parquet"
        target.write_bytes(f.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def test_label_batches_cost_what_they_change(spark, tmp_path):
    rng, seq = random.Random(1), 0
    schema = "case_id string, seq long, action string, value string"
    parts, every = [], []
    for i in range(6):
        rows = []
        for _ in range(25 if i == 0 else 4):
            seq += 1
            action = rng.choice(["save", "save", "draft", "clear"])
            rows.append((f"c{rng.randrange(12)}", seq, action, None if action == "clear" else rng.choice("xyz")))
        parts.append(rows + rows[:1])  # repeats
        every += rows
    stream = fed(spark, parts, schema, f"{tmp_path}/in")
    ST.label_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = L.replayed(spark.createDataFrame(every, schema)).select("case_id", "value", "saves", "provenance")
    state = ST.label_state(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, L.standing(state).collect())) == sorted(map(tuple, want.collect()))
    sizes = {r.version: r["count"] for r in spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").groupBy("version").count().collect()}
    assert sizes[0] > 4 and all(sizes[v] <= 4 for v in sizes if v)  # later batches write what they change
    ST.compacted(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    assert sorted(map(tuple, ST.label_state(spark, f"{tmp_path}/small").collect())) == sorted(map(tuple, state.collect()))


def test_stream_episodes_equal_batch_ones(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for owner in range(6):
        at = 0.0
        for i in range(30):
            at += rng.choice([0.5, 3, 10, 24, 24.5, 30, 60])
            rows.append((f"t{owner % 3}", f"o{owner}", owner * 100 + i, T0 + dt.timedelta(hours=at), "customer" if rng.random() < 0.35 else "brand_agent"))
    # shuffled within 40 hours, so that nothing is late
    rows.sort(key=lambda r: r[3] + dt.timedelta(hours=rng.random() * 40))
    parts = [rows[i : i + 15] for i in range(0, len(rows), 15)] + [[("end", "end", 9000 + i, T0 + dt.timedelta(days=400 + i), "customer")] for i in range(2)]
    changes = ST.episode_changes(fed(spark, parts, MESSAGES, f"{tmp_path}/in"))
    out = f"{tmp_path}/out"
    changes.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/v={n}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    put = spark.read.parquet(out).where("owner_id <> 'end'")
    got = sorted((r.owner_id, r.episode, r["first"], r["last"], r.n) for r in ST.latest_episodes(put).collect())
    frame = spark.createDataFrame(rows, MESSAGES).withColumn("reply_depth", F.lit(0))
    keys = ["conversation_id", "owner_id"]
    batch = E.merged_tails(E.gap_segments(frame, keys), keys).groupBy("owner_id", "segment").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count("*").alias("n"))
    want = sorted(map(tuple, batch.collect()))
    assert got == want
    assert put.count() > len(want)  # tails were shown before they were known to be tails
