"""Operator 3, approximate nearest neighbours: block matrix join over int8 tiles.

Rows are dealt evenly to blocks of about ``BLOCK_BYTES`` of vectors (``BLOCK`` rows at least);
a block is one packed row. The stated queries of each block meet every block in an equality
join on block numbers, and a joined pair of blocks is worked off in tiles of ``TILE``
candidates. In a tile, int8 products give approximate inner products, and the norms of what
quantisation cut off give a bound on their error. Pairs whose upper bound reaches the k-th
best lower bound (or the k-th best score so far) survive, are recomputed in double precision
on the original vectors, and are merged by heaps into the query's best k. A ranking window
merges what the tasks found. With these bounds no true neighbour is lost: recall is 1 up to
ties in the last bit.

Bounds work on vectors divided by a power of two of their own, so that none overflows or
vanishes; what cannot be bounded survives. Products of codes are sums of integers below
2**24, exact in the float32 arithmetic that does them fast (up to 1,040 dimensions; beyond,
float64 does them). Every query has to meet every vector, so the work grows with queries times
vectors; what is sent is one copy of the queries for each block of candidates, which is why
blocks are as large as a task can hold.

Cases: vectors that are null, zero, or hold null or non-finite components, vectors of
another length than the commonest, and rows without vec_id take no part; ties go to the
smaller vec_id; rows that share a vec_id are rows of their own, and neighbours of each
other; a score whose products overflow is infinite, plus infinity if both signs do;
fewer than k candidates are all returned. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BLOCK, TILE, BLOCK_BYTES = 2_048, 2_048, 4 << 20
#: Query blocks whose best lists a task holds before it hands them on.
HELD = 64
_FIELDS = ("ids", "vectors", "codes", "scales", "errors", "powers")
_PACK = "block int, " + ", ".join(f"{f} binary, q_{f} binary" for f in _FIELDS) + ", asked binary"


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of v over 2**power of each row: int8 codes, scale of each row, the norm of what the codes leave out; and the powers."""
    power = np.frexp(np.abs(v).max(axis=1))[1].astype(np.int64)
    small = np.ldexp(v, -power[:, None])
    scale = np.abs(small).max(axis=1) / 127
    codes = np.rint(small / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(small - codes * scale[:, None], axis=1) * (1 + 1e-12), power


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double> and a row number of the rows that take part."""
    fine = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row")).where("vec_id is not null").where(fine)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (width[0] if width else 0))


def gathered(rows: DataFrame, blocks: int, every: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        v = np.array(table.column("v").combine_chunks().flatten(), float).reshape(len(ids), -1)
        order = np.lexsort((*v.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, v = ids[order], v[order]
        codes, scale, error, power = quantise(v)
        asked = np.flatnonzero(ids % every == 0).astype(np.int64)
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int32())}
        for f, x in zip(_FIELDS, (ids, v, codes, scale, error, power)):
            out |= {f: pa.array([x.tobytes()], pa.binary()), f"q_{f}": pa.array([x[asked].tobytes()], pa.binary())}
        return pa.table({**out, "asked": pa.array([asked.tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int"))
    return B.saved(dealt.drop("row").groupBy("block").applyInArrow(pack, _PACK))


class _Side:
    """The candidates of a block, or its queries."""

    def __init__(self, row: dict, block: str, prefix: str) -> None:
        self.block = row[block]
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        n = len(self.ids)
        self.v = np.frombuffer(row[f"{prefix}vectors"], np.float64).reshape(n, -1)
        self.codes = np.frombuffer(row[f"{prefix}codes"], np.int8).reshape(n, -1)
        self.scale = np.frombuffer(row[f"{prefix}scales"], np.float64)
        self.error = np.frombuffer(row[f"{prefix}errors"], np.float64)
        self.power = np.frombuffer(row[f"{prefix}powers"], np.int64)
        self.norm = np.linalg.norm(np.ldexp(self.v, -self.power[:, None]), axis=1)


def tile(q: _Side, asked: np.ndarray, b: _Side, part: slice, k: int, best: list[list[tuple[float, int]]]) -> None:
    """Merge into best (per query a list of (-score, vec_id), nearest first) what a part of block b holds.

    asked: the places of the queries in their own block; a query is no neighbour of itself.
    """
    ids, v, error, norm = b.ids[part], b.v[part], b.error[part], b.norm[part]
    kind = np.float32 if v.shape[1] <= 1040 else np.float64
    approx = (q.codes.astype(kind) @ b.codes[part].astype(kind).T).astype(np.float64) * q.scale[:, None] * b.scale[part]
    bound = (q.norm[:, None] * error + q.error[:, None] * (norm + error)) * (1 + 1e-9) + 1e-12 * q.norm[:, None] * norm
    # back to the size of the original vectors, but for the query's own power, the same for all of a query's pairs
    power = b.power[part]
    with np.errstate(over="ignore", under="ignore"):
        lower, upper = np.ldexp(approx - bound, power), np.nextafter(np.ldexp(approx + bound, power), np.inf)
        lower = np.nextafter(lower, -np.inf)
    # what overflows in the score itself is compared by score: both bounds stay open
    wide = (q.power[:, None] + power > 1000) | (q.power[:, None] + power < -1000) | (np.abs(power) > 1000)
    lower, upper = np.where(wide, -np.inf, lower), np.where(wide, np.inf, upper)
    own = np.flatnonzero((asked >= part.start) & (asked < part.stop)) if q.block == b.block else np.zeros(0, np.int64)
    lower[own, asked[own] - part.start] = upper[own, asked[own] - part.start] = -np.inf
    full = lower.shape[1] > k
    floor = np.partition(lower, -k, axis=1)[:, -k] if full else np.full(len(asked), -np.inf)
    so_far = np.array([-h[k - 1][0] if len(h) >= k else -np.inf for h in best])
    floor = np.maximum(floor, np.where(np.abs(q.power) > 1000, -np.inf, np.nextafter(np.ldexp(so_far, -q.power), -np.inf)))
    alive = ~(upper < floor[:, None])
    alive[own, asked[own] - part.start] = False
    for i in range(len(asked)):
        at = np.flatnonzero(alive[i])
        if len(at):
            with np.errstate(over="ignore", invalid="ignore"):
                score = (v[at] * q.v[i]).sum(axis=1)
            score[np.isnan(score)] = np.inf
            near = np.lexsort((ids[at], -score))[:k]
            new = zip((-score[near]).tolist(), ids[at][near].tolist())
            best[i] = [x for x, _ in zip(heapq.merge(best[i], new), range(k))]


def nearest(vectors: DataFrame, k: int = 20, *, every: int = 20, block: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each row whose vec_id is divisible by every."""
    B.ready(vectors.sparkSession)
    rows = B.saved(usable(vectors))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = block or max(BLOCK, BLOCK_BYTES // (9 * (width or 1)))
    blocks = max(1, -(-n // block))
    packs = gathered(rows, blocks, every)
    # Only the queries of a block travel to every block; candidates stay one row a block.
    asking = packs.where(F.length("asked") > 0).select(F.col("block").alias("from"), "asked", *[f"q_{f}" for f in _FIELDS], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    tiles = asking.join(packs.select("block", *_FIELDS), "block")

    def run(batches):
        held: dict = {}

        def out():
            flat = [(q, b, n, v, -s) for b, (ids, best) in held.items() for n, (q, h) in enumerate(zip(ids.tolist(), best)) for s, v in h]
            held.clear()
            q, b, n, v, s = zip(*flat) if flat else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "home", "place", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q, b = _Side(row, "from", "q_"), _Side(row, "block", "")
                _, best = held.setdefault(q.block, (q.ids, [[] for _ in q.ids]))
                for lo in range(0, len(b.ids), TILE):
                    tile(q, np.frombuffer(row["asked"], np.int64), b, slice(lo, lo + TILE), k, best)
                if len(held) >= HELD:
                    yield out()
        yield out()

    found = tiles.mapInArrow(run, "query_id long, home int, place int, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id, home, place order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
