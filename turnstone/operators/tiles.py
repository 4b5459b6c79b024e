"""Ranks of all documents for each query of a vector search, tile by tile.

Queries and documents are packed in blocks; a joined pair of blocks is worked off by matrix
products, so no pair is ever a row. What leaves a task are a few numbers a query: bounds of its
scores, its best documents, the number of documents ahead of a given one. A score is worked out
for whole tiles without rounding; whatever lies within ``SLACK`` of a limit is then scored again
with rounding and compared by score and key, so results are those of ranking every pair.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators import graph

DOCS, ASKED, ROWS, COLUMNS, SLACK = 8_192, 16_384, 64, 4_096, 3e-6
#: A score is a function of a dict of arrays (cos, lex; a, b: both scaled to 0..1; qi, di, extra) and of round(x, digits).
Score = Callable[[dict, Callable], np.ndarray]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def regular(vectors: DataFrame, key: str, column: str) -> bool:
    """Keys are distinct, and every vector has the same length, finite components and a length above zero."""
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    odd, low, high, n = vectors.agg(F.count_if(~F.coalesce(fine, F.lit(False))), F.min(F.size(v)), F.max(F.size(v)), F.count("*")).first()
    return n > 1 and not odd and low == high and vectors.agg(F.count_distinct(key)).first()[0] == n


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """rows (id long, label long, v array<double>, extra array<double>) as one row a block."""
    blocks = max(1, -(-rows.count() // size))

    def pack(t: pa.Table) -> pa.Table:
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = lambda c: np.array(t.column(c).combine_chunks().flatten(), float).reshape(len(ids), -1)[order]
        data = (ids[order], labels[order], flat("v"), flat("extra"))
        return pa.table({"b": pa.array([t.column("b")[0].as_py()], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "labels", "v", "extra"), data)}})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return graph.saved(dealt.groupBy("b").applyInArrow(pack, "b int, ids binary, labels binary, v binary, extra binary")).select(*[F.col(c).alias(prefix + c) for c in ("b", "ids", "labels", "v", "extra")])


class Tiles:
    """Queries (query, qi, qe and float columns named in extra) against docs (doc, di, embedding), but for a query's own key.

    lexical: a second score of keys (column of queries, row of documents), without vectors. A null label is like no other.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, lexical: Callable, extra: tuple[str, ...] = ()):
        label = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none)).alias("label")
        few = F.array(*[F.col(c).cast("double") for c in extra]).cast("array<double>").alias("extra")
        q = queries.select(F.col("query").alias("id"), label("qi", -(1 << 62)), F.col("qe").cast("array<double>").alias("v"), few)
        d = docs.select(F.col("doc").alias("id"), label("di", -(1 << 61)), F.col("embedding").cast("array<double>").alias("v"), F.array().cast("array<double>").alias("extra"))
        self.lexical, self.known = lexical, None
        queries.sparkSession.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")  # a task is one core
        queries.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # workers import this package
        queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))  # rows are blocks
        self.q, self.d = _packed(q, ASKED, "q_"), _packed(d, DOCS, "d_")
        self.names = queries.select("query", "qi")

    def _run(self, work: Callable, schema: str, limits: DataFrame | None = None) -> DataFrame:
        """What work returns of each tile row: lists of columns. limits: query and lims (array of doubles a query)."""
        sides = self.q
        known = [x for x in (self.known, limits) if x is not None]
        if known:  # a query's few numbers go with its block
            rows = known[0]
            for x in known[1:]:
                rows = rows.join(x, "query", "left")
            home = self.q.select("q_b", "q_ids")
            place = rows.select("query", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in rows.columns if c != "query"]).alias("few"))

            def ids(batches):
                for b in batches:
                    for k, x in zip(b.column("q_b").to_pylist(), b.column("q_ids").to_pylist()):
                        i = np.frombuffer(x, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), k, np.int32))], names=["query", "q_b"])

            def pack(t: pa.Table) -> pa.Table:
                order = np.argsort(t.column("query").to_numpy(), kind="stable")
                few = np.array(t.column("few").combine_chunks().flatten(), float).reshape(len(order), -1)[order]
                return pa.table({"q_b": pa.array([t.column("q_b")[0].as_py()], pa.int32()), "few": pa.array([few.tobytes()], pa.binary())})

            listed = home.mapInArrow(ids, "query long, q_b int").distinct().join(place, "query")
            sides = sides.join(listed.groupBy("q_b").applyInArrow(pack, "q_b int, few binary"), "q_b")
        blocks, asking = self.d.count(), self.q.count()
        tiles = sides.withColumn("d_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(self.d, "d_b")
        tiles = tiles.repartition(max(1, min(blocks * asking, 4_000)))  # a row is much work, however few bytes
        lexical, scaled, told = self.lexical, self.known is not None, bool(known)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    side = lambda p: (np.frombuffer(r[p + "ids"], np.int64), np.frombuffer(r[p + "labels"], np.int64))
                    (qids, qi), (dids, di) = side("q_"), side("d_")
                    qv, dv = (np.frombuffer(r[p + "v"], float).reshape(len(x), -1) for p, x in (("q_", qids), ("d_", dids)))
                    extra = np.frombuffer(r["q_extra"], float).reshape(len(qids), -1)
                    few = np.frombuffer(r["few"], float).reshape(len(qids), -1) if told else np.zeros((len(qids), 0))
                    qn, dn = np.sqrt((qv * qv).sum(axis=1)), np.sqrt((dv * dv).sum(axis=1))
                    parts: list = []
                    for lo in range(0, len(qids), ROWS):
                        at = slice(lo, lo + ROWS)
                        state: dict = {}
                        for left in range(0, len(dids), COLUMNS):
                            d = slice(left, left + COLUMNS)
                            x = {"cos": qv[at] @ dv[d].T / (qn[at, None] * dn[d]), "lex": lexical(qids[at, None], dids[None, d]), "qi": qi[at, None], "di": di[None, d], "extra": [e[:, None] for e in extra[at].T]}
                            if scaled and (few[at, 1] - few[at, 0] < 0.01).any():  # what rounding moves would be scaled up
                                x["cos"] = rounded(x["cos"], 9)
                            own = qids[at, None] == dids[None, d] if np.isin(qids[at], dids[d]).any() else None
                            if scaled:
                                scaling(x, few[at, None, :4])
                            parts.append(work(x, own, qids[at], dids[d], few[at, 4:] if scaled else few[at], state))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

        names = [c.split()[0] for c in schema.split(", ")]
        return tiles.mapInArrow(run, schema)

    def scale(self) -> Tiles:
        """Bounds of both scores of each query, by which a and b are scaled from now on."""

        def work(x, own, q, d, few, state):
            low, high = [], []
            for n in ("cos", "lex"):
                s = np.array(x[n], float)
                hide = np.zeros(s.shape, bool) if own is None else own
                low.append(np.where(hide, np.inf, s).min(axis=1) if own is not None else s.min(axis=1))
                high.append(np.where(hide, -np.inf, s).max(axis=1) if own is not None else s.max(axis=1))
            return q, low[0], high[0], low[1], high[1]

        found = self._run(work, "query long, c0 double, c1 double, l0 double, l1 double")
        self.known = graph.saved(found.groupBy("query").agg(F.round(F.min("c0"), 9).alias("c0"), F.round(F.max("c1"), 9).alias("c1"), F.min("l0").alias("l0"), F.max("l1").alias("l1")))
        return self

    def top(self, scores: dict[str, Score], k: int, relevant: bool = False) -> DataFrame:
        """name, query, doc, score, hit, cos, lex: the k best documents (relevant ones, if asked) of each query by each score, from each block."""
        names = list(scores)

        def work(x, own, q, d, few, state):
            out, other = [], x["qi"] != x["di"] if relevant else None
            for n, f in scores.items():
                s = np.array(np.broadcast_to(f(x, lambda v, _: v), (len(q), len(d))))
                if own is not None:
                    s[own] = -np.inf
                if relevant:
                    s[other] = -np.inf
                floor = s.max(axis=1) if k == 1 else np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
                floor = state[n] = np.maximum(floor, state.get(n, -np.inf))  # k documents of this block reach it
                i, j = np.nonzero((s >= floor[:, None] - SLACK) & (s > -np.inf))
                out.append(_picked(x, f, q, d, i, j, names.index(n)))
            return tuple(np.concatenate(c) for c in zip(*out))

        found = self._run(work, "name int, query long, doc long, score double, hit boolean, cos double, lex double")
        ranked = found.withColumn("rank", F.expr("row_number() over (partition by name, query order by score desc, doc)")).where(F.col("rank") <= k)
        return ranked.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("name") + 1))

    def best(self, scores: dict[str, Score]) -> DataFrame:
        """name, query, best: the rank of the best relevant document by each score; null if none is."""
        first = graph.saved(self.top(scores, 1, relevant=True))
        wide = first.groupBy("query").agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{c}{i}") for i, n in enumerate(scores) for c in ("score", "doc")])
        limits = self.names.select("query").join(wide, "query", "left")
        names = list(scores)

        def work(x, own, q, d, few, state):
            out = []
            for m, f in enumerate(scores.values()):
                s = np.array(np.broadcast_to(f(x, lambda v, _: v), (len(q), len(d))))
                if own is not None:
                    s[own] = -np.inf
                i, j = np.nonzero(s >= few[:, 2 * m, None] - SLACK)
                _, _, doc, exact, *_ = _picked(x, f, q, d, i, j, m)
                limit, key = few[i, 2 * m], few[i, 2 * m + 1]
                ahead = np.bincount(i[(exact > limit) | ((exact == limit) & (doc < key))], minlength=len(q))
                out.append((np.full(len(q), m, np.int32), q, ahead.astype(np.int64)))
            return tuple(np.concatenate(c) for c in zip(*out))

        ahead = self._run(work, "name int, query long, n long", limits).groupBy("name", "query").agg(F.sum("n").alias("n"))
        ahead = ahead.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("name") + 1))
        return ahead.join(first.select("name", "query", F.lit(True).alias("found")), ["name", "query"], "left").select("name", "query", F.when(F.col("found"), F.col("n") + 1).alias("best"))


def scaling(x: dict, few: np.ndarray) -> None:
    """a and b from cos and lex and the bounds (c0, c1, l0, l1) in the last axis of few."""
    for to, of, low, high in (("a", "cos", few[..., 0], few[..., 1]), ("b", "lex", few[..., 2], few[..., 3])):
        span = high - low
        x[to] = np.where(span > 0, (x[of] - low) / np.where(span > 0, span, 1.0), 0.0)
    x["few"] = few


def _picked(x: dict, f: Score, q, d, i, j, name: int):
    """Rows of the pairs (i, j), scored exactly: with rounding."""
    one = {n: np.broadcast_to(x[n], (len(q), len(d)))[i, j] for n in ("cos", "lex", "qi", "di")} | {"extra": [e[i, 0] for e in x["extra"]]}
    one["cos"] = rounded(one["cos"], 9)
    if "few" in x:
        scaling(one, x["few"][i, 0])
    return np.full(len(i), name, np.int32), q[i], d[j], np.array(f(one, rounded), float), one["qi"] == one["di"], one["cos"], np.array(one["lex"], float)
