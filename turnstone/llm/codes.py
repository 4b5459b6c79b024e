"""Operator 13, vector code compression: kd-trees over codebooks.

Vectors of whole numbers (floor of a scaled component) are cut into equal parts; each part
position has a codebook, trained by rounds of assignment and integer means. A round builds a
kd-tree of each codebook on the driver and broadcasts the trees (parts x entries points, a
bound that the parameters set). Tasks search them by branch and bound, a whole batch at a time: at a
node the queries split by the child whose box is nearer, and the other child is visited only
by those whose bound is not above their best. Equal bounds are visited, so of entries at the
same distance the one with the lowest index is always seen and wins. Assignment sends up
one row of integer sums per task, part and entry; sums are added exactly as decimals and
the new entries, again parts x entries of them, come back to the driver.

All arithmetic is on integers. Batches with components so large that 64 bits could overflow
are computed with Python's unbounded ones.

Cases: rows whose vector is null or holds null or non-finite components are dropped, and so
are those whose length differs from that of the vector with the smallest vec_id. A codebook starts with each
of the smallest vec_ids once (of rows that share one, the smallest vector); fewer ids make a
shorter codebook. A null vec_id counts as larger than all others. Lengths that cannot be cut
equally give the first parts one component more. Repeated rows are coded alike. An error too
large for a long is null. No vectors, no rows. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

SCALE = 4096
#: Components below this have squared distances, summed over a vector of up to 2^7 components a part, within 63 bits.
_SMALL = 1 << 27


class Tree:
    """A kd-tree of a codebook (entries x dims integers): nodes with the box of their entries, leaves of a few."""

    LEAF = 2

    def __init__(self, points: list[list[int]]):
        self.points = points
        self.nodes: list[tuple] = []  # (low, high, entries or None, left, right)
        if points:
            self._grow(list(range(len(points))))

    def _grow(self, inside: list[int]) -> int:
        low = [min(self.points[i][d] for i in inside) for d in range(len(self.points[0]))]
        high = [max(self.points[i][d] for i in inside) for d in range(len(self.points[0]))]
        at = len(self.nodes)
        self.nodes.append(())
        wide = max(range(len(low)), key=lambda d: high[d] - low[d], default=None)
        if len(inside) <= self.LEAF or wide is None or high[wide] == low[wide]:
            self.nodes[at] = (low, high, sorted(inside), -1, -1)
            return at
        order = sorted(inside, key=lambda i: (self.points[i][wide], i))
        half = len(order) // 2
        self.nodes[at] = (low, high, None, self._grow(order[:half]), self._grow(order[half:]))
        return at

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of q; ties have the lowest index."""
        kind = q.dtype
        best = np.full(len(q), -1, np.int64)
        least = np.zeros(len(q), kind)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            low, high = (np.array(x, kind) for x in self.nodes[node][:2])
            gap = np.maximum(np.maximum(low - q[rows], q[rows] - high), np.zeros(1, kind))
            return (gap * gap).sum(axis=1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            _, _, entries, left, right = self.nodes[node]
            if entries is not None:
                for e in entries:
                    gap = q[rows] - np.array(self.points[e], kind)
                    d = (gap * gap).sum(axis=1)
                    won = (best[rows] < 0) | (d < least[rows]) | ((d == least[rows]) & (e < best[rows]))
                    best[rows[won]], least[rows[won]] = e, d[won]
                return
            a, b = bound(left, rows), bound(right, rows)
            goes_left = (a <= b).astype(bool)
            for near, far, mine, edge in ((left, right, goes_left, b), (right, left, ~goes_left, a)):
                some, limit = rows[mine], edge[mine]
                visit(near, some)
                visit(far, some[(limit <= least[some]).astype(bool)])  # equal bounds too: a lower index may tie

        if self.nodes:
            visit(0, np.arange(len(q)))
        return best, least


def _cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    size, more = divmod(dims, parts)
    ends = [size * (i + 1) + min(i + 1, more) for i in range(parts)]
    return list(zip([0, *ends[:-1]], ends))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly; scale is a power of two."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale)


def _matrix(vectors: list[list[float]], scale: int, dims: int) -> np.ndarray:
    """Rows of integers: int64 where nothing can overflow, else Python's."""
    m = np.array(vectors, np.float64).reshape(len(vectors), dims)
    if not m.size or np.abs(m).max() * scale < _SMALL - 1:
        return np.floor(m * scale).astype(np.int64)
    out = np.empty(m.shape, object)
    out[:] = [[_whole(x, scale) for x in row] for row in m.tolist()]
    return out


_LIMB = 60


def _limbs(x: int) -> list[int]:
    """x as digits of 60 bits with its sign, least first; one at least."""
    sign, x = (-1, -x) if x < 0 else (1, x)
    out = [sign * (x & ((1 << _LIMB) - 1))]
    while x := x >> _LIMB:
        out.append(sign * (x & ((1 << _LIMB) - 1)))
    return out


def _fits(points: list[list[list[int]]]) -> bool:
    return all(abs(x) < _SMALL for book in points for p in book for x in p)


def _assigned(m: np.ndarray, trees: list[Tree], cuts: list[tuple[int, int]], fits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the squared distances summed over parts."""
    if not fits or max(b - a for a, b in cuts) > 128 or len(cuts) > 8:
        m = m.astype(object)
    codes, error = np.zeros((len(m), len(cuts)), np.int64), np.zeros(len(m), m.dtype)
    for i, (a, b) in enumerate(cuts):
        codes[:, i], d = trees[i].nearest(m[:, a:b])
        error = error + d
    return codes, error


def _first_entries(kept: DataFrame, entries: int) -> list[tuple]:
    """The vectors of the smallest ids, each id once: at most `entries` rows reach the driver."""
    id_order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_v").alias("v"))
    one = kept.groupBy("_id").agg(F.min(id_order).alias("s"))
    return [tuple(r.s.v) for r in one.orderBy("s").limit(entries).collect()]


def trained(kept: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> tuple[list[list[list[int]]], int]:
    """Codebooks (part, entry, component) of kept (_id, _v: arrays of finite doubles), and the length of the vectors."""
    first = _first_entries(kept, entries)
    dims = len(first[0]) if first else 0
    first = [v for v in first if len(v) == dims]
    if any(len(r) != dims for r in first) or len(first) < entries:  # ids whose vectors have another length make room for others
        first = _first_entries(kept.where(F.size("_v") == dims), entries) if first else []
    cuts = _cuts(dims, parts)
    books = [[[_whole(x, scale) for x in v[a:b]] for v in first] for a, b in cuts]
    mine = kept.where(F.size("_v") == dims).select("_v")
    for _ in range(rounds if first else 0):
        trees = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
        fits = _fits(books)

        def sums(batches, trees=trees, fits=fits):
            total: dict[tuple[int, int], list] = {}
            for b in batches:
                m = _matrix(b.column("_v").to_pylist(), scale, dims)
                codes, _ = _assigned(m, trees.value, cuts, fits)
                for i, (lo, hi) in enumerate(cuts):
                    for e in np.unique(codes[:, i]).tolist():
                        rows = m[codes[:, i] == e, lo:hi]
                        have = total.setdefault((i, e), [0, [0] * (hi - lo)])
                        have[0] += len(rows)
                        have[1] = [x + int(y) for x, y in zip(have[1], rows.sum(axis=0))]
            out = [(i, e, d, j, n, x) for (i, e), (n, s) in total.items() for d, t in enumerate(s) for j, x in enumerate(_limbs(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "entry", "place", "limb", "n", "x"])

        got = mine.mapInArrow(sums, "part int, entry int, place int, limb int, n long, x long")
        total: dict[tuple[int, int, int], list[int]] = {}
        for r in got.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # parts x entries x components x limbs rows
            have = total.setdefault((r.part, r.entry, r.place), [0, 0])
            have[0] = max(have[0], r.n)  # every task sends limb 0
            have[1] += int(r.x) << (_LIMB * r.limb)
        for (part, entry, place), (n, x) in total.items():
            books[part][entry][place] = x // n
        trees.unpersist()
    return books, dims


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, *, label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding, label) without embedding, with code (two hex digits a part), error, label_error and codebooks_sha256.

    entries: 256 at most, so that two hex digits hold an index; scale: a power of two.
    """
    if not 1 <= entries <= 256 or parts < 1 or scale < 1 or scale & (scale - 1):
        raise ValueError("entries must be 1 to 256, parts 1 or more and scale a power of two")
    made = ("code", "error", "label_error", "codebooks_sha256")
    return B.shielded(vectors, ("vec_id", "embedding", label), made, lambda d: _compressed(d, label, parts, entries, rounds, scale))


def _compressed(vectors: DataFrame, label: str, parts: int, entries: int, rounds: int, scale: int) -> DataFrame:
    B.ready(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    frame = vectors.select(*[c for c in vectors.columns if c != "embedding"], F.col("vec_id").cast("long").alias("_id"), v.alias("_v"))
    kept = B.saved(frame.where(v.isNotNull() & finite))  # read in every round
    books, dims = trained(kept, parts=parts, entries=entries, rounds=rounds, scale=scale)
    cuts, fits = _cuts(dims, parts), _fits(books)
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    final = kept.where(F.size("_v") == dims).drop("_id")
    names = [c for c in final.columns if c != "_v"]

    def run(batches):
        for b in batches:
            m = _matrix(b.column("_v").to_pylist(), scale, dims)
            codes, error = _assigned(m, trees.value, cuts, fits)
            hexes = [bytes(row).hex() for row in codes.astype(np.uint8)]
            whole = [x if x < 1 << 63 else None for x in error.tolist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(hexes, pa.string()), pa.array(whole, pa.int64())], names=[*names, "code", "error"])

    fields = [f for f in final.schema.fields if f.name != "_v"]
    coded = B.saved(final.mapInArrow(run, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.when(total <= F.lit((1 << 63) - 1), total.cast("long")))
    sums = B.checked_side(coded.groupBy(B.col(label).alias("_label")).agg(total.alias("label_error")))
    out = coded.join(sums, B.col(label).eqNullSafe(F.col("_label")))
    return out.select(*[F.col(c) for c in names], "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part against every entry, round by round."""
    nearest = "(SELECT vec_id, part, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.vec_id, x.part, x.p, b.entry, list_sum(list_transform(list_zip(x.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {book} b USING (part)) GROUP BY ALL)"
    steps = []
    for r in range(1, rounds + 1):
        before = f"b{r - 1}"
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT part, entry, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM {nearest.format(book=before)} CROSS JOIN range(1, {width + 1}) t(i) GROUP BY ALL), "
            f"m{r} AS MATERIALIZED (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM a{r} GROUP BY ALL), "
            f"b{r} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, {before}.e) AS e FROM {before} LEFT JOIN m{r} USING (part, entry))"
        )
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda y: floor({SCALE} * y)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, part, e[part * {width} + 1:part * {width} + {width}] AS p FROM v CROSS JOIN range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS e FROM x QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}),
{', '.join(steps)},
f AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {nearest.format(book=f'b{rounds}')} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id) CROSS JOIN h"""


ORACLE = _sql()
