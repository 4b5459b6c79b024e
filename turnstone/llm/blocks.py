"""Documents in blocks, and exchanges between blocks and buckets.

Several operators need corpus-wide facts about small items (windows, words) without a row
for each item. They work on *blocks*: documents dealt by a hash of doc_id, about
``block_bytes`` of text each. Each block sends every *bucket* (a hash range of items) one
packed row with its distinct items, the bucket answers each block with one packed row in
the order sent. As a block combines its own copies first, an item that is in a third of
all documents costs a bucket one entry a block, never one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes of a block. A task holds one block and a few arrays of its size.
BLOCK_BYTES = 4 << 20
#: Arrow batch bounds for Python operators, so that a batch of long texts fits in a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what ready() sets without it."""
    ready(spark)
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()).rstrip("/")


def ready(spark: SparkSession) -> None:
    """Set batch bounds, and a checkpoint folder where the cluster names none."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    sc.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # workers import this package
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, *, laid_out: bool = False) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder.

    laid_out: remember df's partitioning, so that later groupings by its key need no exchange
    (a plan that adaptive execution has changed does not tell its partitioning).
    """
    spark = df.sparkSession
    ready(spark)
    if not laid_out:
        return df.checkpoint()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def checked_side(side: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A join side computed once, with a broadcast hint only if it has at most max_rows rows."""
    side = saved(side)
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def col(name: str) -> Column:
    """The column of just this name, whatever dots or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shielded(docs: DataFrame, uses: tuple[str, ...], makes: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with every column but uses under a neutral name meanwhile, and its own again after.

    So no name of a passing column can clash with one an operator uses inside. Columns of the
    names in makes, in upper or lower case, are dropped first.
    """
    names = docs.columns
    used = {names.index(u) for u in uses if u in names}
    inside = [c if i in used else f"_x{i}" for i, c in enumerate(names)]
    dropped = {m.lower() for m in makes}
    frame = docs.toDF(*inside).select(*[inside[i] for i, c in enumerate(names) if i in used or c.lower() not in dropped])
    outside = dict(zip(inside, names))
    out = run(frame)
    return out.toDF(*[outside.get(c, c) for c in out.columns])


def rest_of(docs: DataFrame, *used: str) -> Column:
    """All other columns of docs as one struct."""
    other = [c for c in docs.columns if c not in used]
    return F.struct(*[col(c).alias(f"x{i}") for i, c in enumerate(other)]) if other else F.lit(None).cast("struct<x0:string>")


def restored(df: DataFrame, docs: DataFrame, *used: str, rest: str = "rest") -> list[Column]:
    """Select list that has the columns of docs in their order; those used come from df."""
    other = [c for c in docs.columns if c not in used]
    return [col(c) if c in used else F.col(f"{rest}.x{other.index(c)}").alias(c) for c in docs.columns]


def n_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def packed(docs: DataFrame, blocks: int, *, rest: bool = False) -> DataFrame:
    """block, doc_id, row, body (zstd of the UTF-8 text, null for null) and rest, dealt by block and saved.

    row numbers the rows of docs, so that rows that share a doc_id are told apart and spread
    over blocks like any others.
    """
    ready(docs.sparkSession)
    frame = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").cast("binary").alias("body"),
        (rest_of(docs, "doc_id", "text") if rest else F.lit(None).cast("struct<x0:string>")).alias("rest"),
    )
    frame = frame.select(F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int").alias("block"), "*")

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            body = [None if x is None else z.compress(x) for x in b.column("body").to_pylist()]
            yield b.set_column(b.schema.get_field_index("body"), "body", pa.array(body, pa.binary()))

    return saved(frame.mapInArrow(squeeze, frame.schema).repartition(blocks, "block"), laid_out=True)


def documents_of(table: pa.Table) -> tuple[list, list[int], list[bytes | None], np.ndarray]:
    """doc_ids, row numbers, texts and places in the table of a block, in (doc_id, row) order; a null doc_id comes last."""
    z = zstandard.ZstdDecompressor()
    ids, rows = table.column("doc_id").to_pylist(), table.column("row").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
    body = table.column("body").to_pylist()
    return [ids[i] for i in order], [rows[i] for i in order], [None if body[i] is None else z.decompress(body[i]) for i in order], np.array(order, dtype=np.int64)


def by_bucket(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket number in of with the places that have it, in order: one sort, whatever the number of buckets."""
    order = np.argsort(of, kind="stable")
    each, first = np.unique(of[order], return_index=True)
    return zip(each.tolist(), np.split(order, first[1:])) if len(of) else iter(())


#: What blocks and buckets send each other.
MAIL = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("body", T.BinaryType())])


def mail(rows: list[tuple[int, int, bytes]], block: pa.DataType = pa.int32()) -> pa.Table:
    blocks, buckets, bodies = zip(*rows) if rows else ((), (), ())
    return pa.table({"block": pa.array(blocks, block), "bucket": pa.array(buckets, pa.int32()), "body": pa.array(bodies, pa.binary())})


def in_order(table: pa.Table, key: str) -> list[tuple[int, bytes]]:
    return sorted(zip(table.column(key).to_pylist(), table.column("body").to_pylist()))
