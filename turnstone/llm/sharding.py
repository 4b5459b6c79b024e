"""Operator 6, sharding: Hilbert-curve ordering.

Metadata dimensions (language, source, length) are quantised to ``bits`` bits each, in their
own order: names by the share of rows that have a smaller name, length by its logarithm
between the shortest and the longest. Rows are sorted by their index on the Hilbert curve
through that grid (then by doc_id), and cut into runs, so a shard covers a small box in every
dimension and the least and greatest value of a column in a file let a reader skip most files.
The law is ``rows``: shard sizes differ by at most one row.

Only narrow rows (no text) are sorted: a range partitioning by curve index and doc_id, which
splits a hot source by length and doc_id. Ranks come from the partitions' row counts, a
table of one row a partition.

Cases: null text has no bytes and CRC 0; null lang and source are values of their own; a null
doc_id sorts first and a null name before all others; rows that share all keys get neighbouring slots; fewer rows than shards
leave shards empty. Empty tables give empty results; columns of the names made here are
replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

MADE = ("size", "text_crc32", "law", "curve", "shard", "slot", "grown_shard")
DIMENSIONS = ("lang", "source", "length")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of points (n x d, below 2**bits), by Skilling's transform."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(points), np.int64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << b)) != 0, turn ^ ((1 << b) - 1), turn)
    out = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for column in x:
            out = (out << 1) | (((column ^ turn) >> b) & 1)
    return out


def _named(rows: DataFrame, name: str, top: int) -> DataFrame:
    """rows with _lang or _source: the place of a row's name among all rows' names, in 0 .. top."""
    counts = rows.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("n"))  # one row a name
    w = Window.orderBy(F.asc_nulls_first("_name"))
    place = (F.sum("n").over(w) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy())
    places = B.checked_side(counts.select("_name", F.floor(place * top).cast("int").alias(f"_{name}")))
    return rows.join(places, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def hilbert_shards(docs: DataFrame, shards: int = 40, *, bits: int = 8) -> DataFrame:
    """docs without text, with size, text_crc32, law, curve, shard, slot and grown_shard."""
    return B.shielded(docs, ("doc_id", "text", "lang", "source"), MADE, lambda d: _hilbert_shards(d, shards, bits))


def _hilbert_shards(docs: DataFrame, shards: int, bits: int) -> DataFrame:
    spark = docs.sparkSession
    B.ready(spark)
    text, top = F.coalesce(F.col("text").cast("string"), F.lit("")), (1 << bits) - 1
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*others, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    low, high = docs.agg(F.min(F.log2(F.octet_length(text) + 16.0)), F.max(F.log2(F.octet_length(text) + 16.0))).first()
    length = F.round((F.log2(F.col("size").cast("double")) - F.lit(low or 0.0)) / F.lit(max(1e-9, (high or 0.0) - (low or 0.0))) * top).cast("int")
    grid = _named(_named(rows, "lang", top), "source", top).select(*rows.columns, F.struct("_lang", "_source", length.alias("_length")).alias("_grid"))
    schema = T.StructType([*rows.schema.fields, T.StructField("curve", T.LongType())])

    def index(batches):
        for b in batches:
            cells = b.column("_grid").flatten()
            curve = hilbert(np.column_stack([c.to_numpy(zero_copy_only=False) for c in cells]).reshape(-1, len(DIMENSIONS)), bits)
            b = b.drop_columns(["_grid"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve)], names=[*b.schema.names, "curve"])

    keys = ["curve", "doc_id", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = B.saved(grid.mapInArrow(index, schema).repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    at = laid.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted(tuple(r) for r in at.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    total, before = 0, []
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "_part int, _before long"))
    rank = F.col("_before") + F.col("_row")
    shard = F.floor(rank * shards / F.lit(max(total, 1))) if total * shards >= 1 << 53 else F.expr(f"(_before + _row) * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    out = at.join(starts, "_part").withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(*others, *MADE)
