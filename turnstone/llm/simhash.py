"""Operator 10, SimHash near-dedup: deletion-variant signatures.

Fingerprints of 64 bits link at 2 or fewer differing bits. Cut in two halves, one half of
any linked pair differs by at most one bit. Each half is indexed under its 32 one-wildcard
variants (the half without one bit), so that linked pairs meet in an equality of
(half, wildcard, remaining 31 bits); the whole fingerprints are then verified.

Work is per different fingerprint, however many documents have it. No bucket emits all its
pairs. A window over a bucket gives each member the bucket's smallest fingerprint, AND and
OR: if AND and OR differ in at most 2 bits, all members are linked and a star to the
smallest stands for them. Members of other buckets go on to the second index, one-wildcard
variants of the whole fingerprint: two differ in at most 2 bits exactly if they share one,
so the members of such a group form a verified star. Both indexes are one shuffle each, all
of it is exact, and nothing is capped or depends on a bucket's size.

Components come from repeated min-label steps with pointer jumping, over linked
fingerprints only, with lineage cut by checkpoints.

Cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer
words than ``shingle`` are one shingle; a null doc_id counts as larger than all others, and
a component of null ids alone has a null component_id; repeated rows are kept. Empty tables
give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

_MAX = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned SimHash of a UTF-8 text; bit set if set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes.lower() lowers A-Z only, split() takes 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(w), 42) for w in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, n in enumerate(ones.tolist()) if 2 * n > len(h))


def with_fingerprint(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs with a signed 64-bit fingerprint of text, in one pass without a shuffle."""
    B.ready(docs.sparkSession)
    frame = docs.select(*docs.columns, F.col("text").cast("string").cast("binary").alias("_body"))

    def run(batches):
        for b in batches:
            body = b.column("_body").to_pylist()
            fp = np.array([fingerprint(x or b"", shingle) for x in body], np.uint64).view(np.int64)
            b = b.drop_columns(["_body"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    return frame.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _without(bit: int, half: Column) -> Column:
    """A half with one bit set to 0."""
    return half.bitwiseAND(F.lit(~(1 << bit)))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b), a < b, whose closure joins all of the distinct fingerprints fp at 2 or fewer bits."""
    if bits != 2:
        raise ValueError("the two-halves scheme is made for 2 differing bits")
    fp = F.col("fp")
    # slot: which bit of the fingerprint is the wildcard; the other bits of its half are kept
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    variants = F.array(*[F.struct(F.lit(i).alias("slot"), _without(i, low).alias("rest")) for i in range(32)], *[F.struct(F.lit(32 + i).alias("slot"), _without(i, high).alias("rest")) for i in range(32)])
    index = fps.select("fp", F.explode(variants).alias("v")).select("fp", (F.col("v.rest") * 64 + F.col("v.slot")).alias("key"))
    bucket = Window.partitionBy("key")
    buckets = index.select(
        "fp", F.count("fp").over(bucket).alias("n"), F.min("fp").over(bucket).alias("least"),
        F.bit_count(F.bit_and("fp").over(bucket).bitwiseXOR(F.bit_or("fp").over(bucket))).alias("apart"),
    ).where("n > 1")
    near = F.col("apart") <= bits
    # of two members that are too far apart nothing can be linked
    members = B.saved(buckets.where(near & (F.col("fp") != F.col("least")) | ~near & (F.col("n") > 2)).select(F.when(near, F.col("least")).alias("least"), "fp").distinct())
    stars = members.where("least is not null").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    values = F.array(fp, *[fp.bitwiseXOR(F.lit(1 << i if i < 63 else -_MAX - 1)) for i in range(64)])
    named = members.where("least is null").select("fp", F.explode(values).alias("value"))
    group = Window.partitionBy("value")
    hubs = named.select(F.min("fp").over(group).alias("a"), F.col("fp").alias("b")).where("a <> b")
    # a and b both name the same value: at most one bit from it each
    return stars.unionByName(hubs).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes of edges (a, b) of longs.

    Alternates large-star and small-star steps (each node passes its smallest neighbour on)
    until no edge changes; a step groups by node and keeps no group in memory.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = B.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = mark(edges)
    while True:
        # Large star: neighbours above a node move to its smallest neighbour. The joins are
        # merge joins on a key both sides are grouped by; no side is broadcast.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.withColumnRenamed("m", "v"))
        edges = B.saved(small.where("u <> v").distinct())
        if (now := mark(edges)) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """docs without text, with fingerprint (16 hex digits) and component_id; columns of these names are replaced."""
    return B.shielded(docs, ("doc_id", "text"), ("fingerprint", "component_id"), lambda d: _near_duplicates(d, shingle))


def _near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    frame = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"), B.rest_of(docs, "doc_id", "text").alias("rest"))
    frame = B.saved(with_fingerprint(frame, shingle).drop("text"))
    found = component_ids(frame)
    return frame.join(found, "fp").select(*B.restored(frame, docs.select(*rest), "doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_roots(frame: DataFrame) -> DataFrame:
    """fp, root for each different fp of frame; fingerprints of a component share the root."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = B.saved(frame.select("fp").distinct().repartition(parts, "fp"))  # few bytes, but each row becomes 64
    roots = components(links(groups))
    return groups.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def component_ids(frame: DataFrame) -> DataFrame:
    """fp, component_id for each different fp of frame (doc_id, fp)."""
    least = frame.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    linked = B.saved(component_roots(frame).join(least.hint("merge"), "fp"))
    ids = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    return linked.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id (then fingerprint, then text)."""
    return B.shielded(docs, ("doc_id", "text"), (), lambda d: _one_of_each(d, shingle))


def _one_of_each(docs: DataFrame, shingle: int) -> DataFrame:
    keys = docs.select("doc_id", "text")
    frame = B.saved(with_fingerprint(keys, shingle).select(F.col("doc_id").cast("long").alias("doc_id"), "fp"))
    first = frame.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("s"))  # one row a fingerprint before the join
    found = first.join(component_roots(frame).hint("merge"), "fp")
    chosen = found.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.fp").alias("_fp"))
    rows = with_fingerprint(docs, shingle, "_own")
    rows = rows.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_fp")), "left_semi")
    place = F.row_number().over(Window.partitionBy("_own", "doc_id").orderBy(F.asc_nulls_first("text")))
    return rows.withColumn("_place", place).where("_place = 1").select(*docs.columns)
