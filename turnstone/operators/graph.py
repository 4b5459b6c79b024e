"""Graphs of long ids: connected components and walks to ancestors, without driver loops over rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbours of a node that one task may gather at any size of graph.
HUB = 1 << 16


def saved(df: DataFrame) -> DataFrame:
    """df computed once; lineage is cut in the shared checkpoint folder (never on one executor)."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like saved(), as compressed columns: for large tables that several passes read. The files stay in the checkpoint folder as checkpoints do."""
    spark = df.sparkSession
    saved(spark.range(0))  # sees to a checkpoint folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _size(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


def _led(rows: DataFrame, by: DataFrame, least, total: int) -> DataFrame:
    """rows (u, v) with m, the least() of their u's rows in by, out of total rows; few u have many rows, and those are not gathered."""
    of = by.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    many = max(HUB, total // 1024)
    hubs = saved(of.where(F.col("n") > many).select("u", F.col("m").alias("h"))) if total > many else None  # 1,024 at most
    if hubs is None or hubs.isEmpty():
        return rows.join(of, "u").select("u", "v", "m")
    known = rows.join(F.broadcast(hubs), "u", "left")
    return known.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(known.where("h is null").join(of, "u").select("u", "v", "m"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root (smallest node of the component) for edges (a, b); nodes adds nodes without edges.

    Large-star and small-star steps: O(log n) rounds even on chains; each is a few equi-joins.
    Nodes of very many neighbours (a large component ends as one star) get theirs by broadcast.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, size = None, _size(now)
    while size != before:
        before = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _led(both.where("v > u"), both, F.least(F.min("v"), F.first("u")), 2 * size[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large) if size[0] > HUB else large
        below = large.groupBy("u").agg(F.min("v").alias("v"))
        moved = _led(large, large, F.min("v"), size[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(moved.unionByName(below).where("u <> v").distinct())
        size = _size(now)
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    every = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    every = (every.union(nodes) if nodes is not None else every).distinct()
    return every.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def ancestors(parents: DataFrame, stop: str | None = None) -> DataFrame:
    """node, depth, top, found: steps to the last ancestor, that ancestor, and the nearest one marked by stop.

    parents has node, parent (null or missing from node: a root) and, if stop is given, that
    boolean column. Pointer jumping doubles the reach each round. A node on a cycle or above
    one walks once around it: depth counts the steps until a node would be visited again.
    """
    base = parents.select("node", "parent", (F.col(stop) if stop else F.lit(False)).alias("hit"))
    known = base.select(F.col("node").alias("parent"))
    base = base.join(known.distinct().withColumn("there", F.lit(True)), "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("to"), "hit")
    base = saved(base.withColumn("to", F.when(F.col("to") == F.col("node"), F.lit(None)).otherwise(F.col("to"))))
    # depth: steps taken; near: nearest marked ancestor in them; low: smallest node in them
    marks = base.where("hit").select(F.col("node").alias("to"), F.col("node").alias("near"))
    now = saved(base.join(marks, "to", "left").select("node", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.coalesce("to", "node").alias("top"), "near", F.least("node", "to").alias("low")))
    total = base.count()
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("top").alias("far"), F.col("near").alias("later"), F.col("low").alias("lower"))
        now = saved(now.join(ahead, "to", "left").select(
            "node", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("far", "top").alias("top"), F.coalesce("near", "later").alias("near"), F.least("low", "lower").alias("low")
        ))
        deepest = now.where("to is not null").agg(F.max("depth")).first()[0]
        if deepest is None or deepest > total:
            break
    out = now.where("to is null").select("node", "depth", "top", F.col("near").alias("found"))
    return out if deepest is None else out.unionByName(_around(base, now.where("to is not null")))


def _around(base: DataFrame, open_: DataFrame) -> DataFrame:
    """node, depth, top, found of the nodes that lead into a cycle, from walks (open_) longer than there are nodes.

    Such a walk ends on its cycle, and the ends of all walks are the cycles' nodes: a cycle's
    nodes map onto themselves. Its smallest node names a cycle, since a walk from there has seen
    all of it. What is left are trees that hang from cycle nodes.
    """
    ring = saved(open_.select(F.col("to").alias("node")).distinct().join(open_, "node").select("node", F.col("low").alias("ring")))
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size"))
    before = base.join(ring, "node").select(F.col("to").alias("entry"), F.col("node").alias("last"))  # who leads to a node along its cycle
    cycles = saved(ring.join(sizes, "ring").select(F.col("node").alias("entry"), "size").join(before, "entry"))
    loops = open_.select("node", F.col("near").alias("found"))
    branches = loops.join(ring, "node", "left_anti")
    ways = ring.select("node", F.lit(0).cast("long").alias("steps"), F.col("node").alias("entry"))
    if not branches.isEmpty():
        hang = base.join(loops, "node").join(ring, "node", "left").select("node", F.when(F.col("ring").isNull(), F.col("to")).alias("parent"))
        ways = ancestors(hang).select("node", F.col("depth").alias("steps"), F.col("top").alias("entry"))
    return ways.join(cycles, "entry").join(loops, "node").select("node", (F.col("steps") + F.col("size") - 1).alias("depth"), F.col("last").alias("top"), "found")
