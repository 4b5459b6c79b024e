"""Many models in one scan: k-means for all k, seeds and starts, logistic regression for a whole grid.

Fitting one model after another reads the data once a model and round. Here every round reads
it once and updates all models that have not settled: tasks add up one block of sums for all
of them (NumPy over Arrow batches), sums meet in one aggregate, and what the driver holds is
the models themselves, whose size parameters set: models x centres x dimensions, or
terms x classes x grid, where terms is the width of the hashed term space.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import graph

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions themselves: workers need not have the package

# ---- sums of blocks ----


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """slot to the sum of its arrays x, for rows (slot, x) of a few slots; x of a slot has one length."""
    sums = parts.groupBy("slot").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("x")))).alias("x")).toArrow()
    slots, x = sums.column("slot").to_pylist(), sums.column("x").combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
    ends, flat = np.cumsum(np.asarray(x.value_lengths()).astype(np.int64)) if slots else [], np.asarray(x.flatten())
    return dict(zip(slots, np.split(flat, ends[:-1]))) if slots else {}


def _slots(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum([x.size for x in total.values()]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.ravel(x) for x in total.values()])))], names=["slot", "x"])


def _for_scans(df: DataFrame) -> DataFrame:
    """df saved, read by no more tasks than there are cores: each task sends one block of sums a round."""
    df = graph.saved(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if df.rdd.getNumPartitions() > cores else df


def _scan(rows: DataFrame, work: Callable[[pa.RecordBatch, dict], None]) -> dict[int, np.ndarray]:
    """What work adds to its dict of slots, over all batches of all tasks."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                work(b, total)
        if total:
            yield _slots(total)

    return _added(rows.mapInArrow(run, "slot long, x array<double>"))


def _add(total: dict, slot: int, x) -> None:
    x = np.atleast_1d(np.asarray(x, np.float64))
    total[slot] = total[slot] + x if slot in total else x


# ---- k-means ----

#: Candidates for first centres that a start looks at, for each centre of the largest k.
POOL = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Clusters:
    """A k-means model: the best of several starts."""

    k: int
    seed: int
    centres: np.ndarray
    inertia: float = float("nan")
    rounds: int = 0


def _pools(rows: DataFrame, tags: list[tuple[int, int]], size: int) -> list[np.ndarray]:
    """For each (seed, start) the vectors of the `size` rows of least hash: the same rows on every run."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            h, m = np.asarray(b.column("h")).astype(np.int64).view(np.uint64), _matrix(b.column("v"))
            for i, (seed, start) in enumerate(tags):
                score = _mix(h ^ _mix(np.full(1, seed * 1000 + start + 1, np.uint64)))
                if i in best:
                    score, mine = np.concatenate((best[i][0], score)), np.concatenate((best[i][1], m))
                else:
                    mine = m
                keep = np.argsort(score, kind="stable")[:size]
                best[i] = score[keep], mine[keep]
        for i, (score, m) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(m), pa.int64()), pa.array((score >> np.uint64(1)).astype(np.int64)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["i", "score", "v"])

    from pyspark.sql import Window

    few = rows.mapInArrow(run, "i long, score long, v array<double>")  # size rows a start and task
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("score", "v"))).where(F.col("place") <= size)
    found: dict[int, list] = {}
    for r in few.orderBy("i", "place").collect():  # size rows a start
        found.setdefault(r.i, []).append(r.v)
    return [np.array(found[i]) for i in range(len(tags))]


def first_centres(pool: np.ndarray, k: int, seed: int, start: int) -> np.ndarray:
    """k rows of a pool, each further one drawn with the weight of its squared distance from those before."""
    rng = np.random.default_rng([seed, start, k])
    chosen = [int(rng.integers(len(pool)))]
    far = ((pool - pool[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(pool), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(pool))))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return pool[chosen]


def _labels(m: np.ndarray, stacked: np.ndarray, sizes: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each model of `sizes` centres in stacked, the rows' nearest centres and squared distances."""
    d = (stacked * stacked).sum(axis=1) - 2 * (m @ stacked.T)
    own, at, labels, least = (m * m).sum(axis=1), 0, [], []
    for k in sizes:
        part = d[:, at : at + k]
        label = part.argmin(axis=1)
        labels.append(label)
        least.append(np.maximum(part[np.arange(len(m)), label] + own, 0))
        at += k
    return labels, least


def vector_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    """h (a hash of the key) and v, saved; rows whose vector is null, empty or not finite take no part."""
    v = F.col(array).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _for_scans(df.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.xxhash64(F.col(key)).alias("h"), v.alias("v")))


def fitted(rows: DataFrame, specs: list[tuple[int, int]], starts: int = 10, rounds: int = 100, tol: float = 1e-4) -> list[Clusters]:
    """The best of `starts` k-means models of each spec (k, seed), from vector_rows(); all are fitted together.

    A model has settled when its centres move less than tol times the mean variance of a
    dimension, all squared distances added. Empty clusters keep their centres.
    """
    first = rows.first()
    if first is None:
        raise ValueError("k-means needs at least one vector")
    most = max(k for k, _ in specs)
    tags = [(seed, s) for seed in sorted({seed for _, seed in specs}) for s in range(starts)]
    pools = dict(zip(tags, _pools(rows, tags, POOL * most)))
    models = [Clusters(k, seed, first_centres(pools[seed, s], k, seed, s)) for k, seed in specs for s in range(starts)]

    def spread(b: pa.RecordBatch, total: dict) -> None:
        m = _matrix(b.column("v"))
        _add(total, 0, np.concatenate(([len(m)], m.sum(axis=0), (m * m).sum(axis=0))))

    s = _scan(rows, spread)[0]
    dims = len(first.v)
    enough = tol * float(np.mean(s[1 + dims :] / s[0] - (s[1 : 1 + dims] / s[0]) ** 2))
    active = list(models)
    for _ in range(rounds):
        stacked, sizes = np.concatenate([m.centres for m in active]), [m.k for m in active]
        held = rows.sparkSession.sparkContext.broadcast((stacked, sizes))

        def step(b: pa.RecordBatch, total: dict, held=held) -> None:
            stacked, sizes = held.value
            m = _matrix(b.column("v"))
            one, at = np.zeros((len(m), len(stacked))), 0
            for k, label in zip(sizes, _labels(m, stacked, sizes)[0]):
                one[np.arange(len(m)), at + label] = 1.0
                at += k
            sums = np.concatenate((one.sum(axis=0)[:, None], one.T @ m), axis=1)
            total["all"] = total["all"] + sums if "all" in total else sums

        def run(batches, step=step):
            total: dict = {}
            for b in batches:
                if b.num_rows:
                    step(b, total)
            if total:
                yield _slots(dict(enumerate(total["all"])))

        got = _added(rows.mapInArrow(run, "slot long, x array<double>"))
        held.unpersist()
        at, going = 0, []
        for model in active:
            now = model.centres.copy()
            for c in range(model.k):
                n, x = got[at + c][0], got[at + c][1:]
                if n > 0.5:
                    now[c] = x / round(n)
            moved = float(((now - model.centres) ** 2).sum())
            model.centres, model.rounds, at = now, model.rounds + 1, at + model.k
            if moved > enough:
                going.append(model)
        active = going
        if not active:
            break
    stacked, sizes = np.concatenate([m.centres for m in models]), [m.k for m in models]

    def cost(b: pa.RecordBatch, total: dict) -> None:
        _add(total, 0, [d.sum() for d in _labels(_matrix(b.column("v")), stacked, sizes)[1]])

    for model, x in zip(models, _scan(rows, cost)[0]):
        model.inertia = float(x)
    return [min((m for m in models if (m.k, m.seed) == spec), key=lambda m: m.inertia) for spec in specs]


def assigned(df: DataFrame, array: str, model: Clusters, to: str = "cluster") -> DataFrame:
    """df with the nearest centre of each row, held-out rows too; null where the vector is null. JVM expressions only."""
    gap = lambda c: F.aggregate(F.zip_with(F.col(array), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    near = F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(model.centres)]))
    return df.withColumn(to, F.when(F.col(array).isNotNull(), near["c"]))


def _rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of counts."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    n, ij, a, b = table.sum(), pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected, most = a * b / max(1.0, n * (n - 1) / 2), (a + b) / 2
    return 1.0 if most == expected else float((ij - expected) / (most - expected))


def swept(df: DataFrame, key: str, array: str, ks: range = range(8, 16), seed: int = 42, starts: int = 5) -> list[dict]:
    """For each k: silhouette (cosine), inertia, agreement of two seeds (ARI), smallest share.

    All models are fitted together; two more scans give the figures of all of them: one counts
    clusters, pairs of labels and sums of unit vectors, one the silhouettes from those sums.
    """
    rows = vector_rows(df, key, array)
    specs = [(k, s) for k in ks for s in (seed, seed + 1)]
    models = fitted(rows, specs, starts)
    stacked, sizes = np.concatenate([m.centres for m in models]), [m.k for m in models]
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]

    def counts(b: pa.RecordBatch, total: dict) -> None:
        m = _matrix(b.column("v"))
        labels, _ = _labels(m, stacked, sizes)
        u = unit(m)
        for i, k in enumerate(ks):
            x, y = labels[2 * i], labels[2 * i + 1]
            _add(total, 2 * i, np.bincount(x * k + y, minlength=k * k))
            one = np.zeros((len(m), k))
            one[np.arange(len(m)), x] = 1.0
            _add(total, 2 * i + 1, (one.T @ u).ravel())

    got = _scan(rows, counts)
    tables = [np.rint(got[2 * i]).reshape(k, k) for i, k in enumerate(ks)]
    sums = [got[2 * i + 1].reshape(k, -1) for i, k in enumerate(ks)]

    def silhouettes(b: pa.RecordBatch, total: dict) -> None:
        m = _matrix(b.column("v"))
        labels, _ = _labels(m, stacked, sizes)
        u = unit(m)
        out = []
        for i in range(len(tables)):
            n, label, at = tables[i].sum(axis=1), labels[2 * i], np.arange(len(m))
            product = u @ sums[i].T
            mean = 1 - product / np.maximum(n, 1)
            mean[:, n == 0] = np.inf
            own = (n[label] - product[at, label]) / np.maximum(n[label] - 1, 1)  # a row's distance from itself is 0
            mean[at, label] = np.inf
            other = mean.min(axis=1)
            score = np.where((n[label] > 1) & np.isfinite(other), (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
            out.append(score.sum())
        _add(total, 0, out)

    scores = _scan(rows, silhouettes)[0]
    out = []
    for i, k in enumerate(ks):
        n = tables[i].sum()
        out.append({"k": k, "silhouette": float(scores[i] / n), "inertia": models[2 * i].inertia, "seed_ari": _rand_index(tables[i]), "min_share": float(tables[i].sum(axis=1).min() / n), "model": models[2 * i]})
    return out


# ---- term features of a bounded width ----

#: Width of the hashed term space: the coefficients of a class and C are so many numbers, however large the vocabulary.
WIDTH = 1 << 16


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each entry of a list column, and the entries."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), np.asarray(column.flatten())


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The list column of n rows that has values at their rows, which ascend."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)), pa.array(values))


def _mapped(frame: DataFrame, drop: str, work: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """frame without the columns in drop, with lists at and x; work gives row, at and x of a batch's entries."""
    keep = [f for f in frame.schema.fields if f.name not in drop.split()]

    def run(batches):
        for b in batches:
            row, at, x = work(b)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], _lists(row, at.astype(np.int32), b.num_rows), _lists(row, x.astype(np.float32), b.num_rows)], names=[*[f.name for f in keep], "at", "x"])

    return frame.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "at array<int>, x array<float>"]))


def hashed(docs: DataFrame, terms: Column, *keep: str, width: int = WIDTH) -> DataFrame:
    """keep, at, x: the hashed terms of each row, ascending, and 1 + ln of their counts. One pass, no shuffle."""
    frame = docs.select(*keep, F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int")).alias("__t"))

    def work(b):
        row, at = _entries(b.column("__t"))
        pair, tf = np.unique(row * width + at, return_counts=True)
        return pair // width, pair % width, 1 + np.log(tf)

    return _mapped(frame, "__t", work)


@dataclass
class Weights:
    """Inverse document frequencies of hashed terms; those in fewer than min_df training documents weigh nothing."""

    idf: np.ndarray = field(repr=False)

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows of hashed() with x as TF-IDF of unit length."""
        held = rows.sparkSession.sparkContext.broadcast(self.idf)

        def work(b):
            row, at = _entries(b.column("at"))
            x = np.asarray(b.column("x").flatten()) * held.value[at]
            row, at, x = row[x > 0], at[x > 0], x[x > 0]
            return row, at, x / np.sqrt(np.bincount(row, x * x, minlength=b.num_rows))[row]

        return _mapped(rows, "at x", work)


def term_weights(rows: DataFrame, min_df: int = 2, width: int = WIDTH) -> Weights:
    """Document frequencies from rows of hashed(): at most `width` counts leave a task or reach the driver."""

    def count(b: pa.RecordBatch, total: dict) -> None:
        _add(total, 0, np.bincount(np.asarray(b.column("at").flatten()), minlength=width))
        _add(total, 1, b.num_rows)

    got = _scan(rows, count)
    df, n = (np.rint(got[0]), got[1][0]) if got else (np.zeros(width), 0)
    return Weights(np.where(df >= min_df, np.log((1 + n) / (1 + df)) + 1, 0.0))


# ---- logistic regression, a whole grid at once ----


@dataclass
class _Search:
    """One C of the grid: a limited-memory quasi-Newton search that is fed loss and gradient from outside."""

    penalty: float
    at: np.ndarray
    memory: int = 8
    loss: float = float("inf")
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def asks(self) -> np.ndarray:
        return self.at if self.way is None else self.at + self.step * self.way

    def told(self, loss: float, slope: np.ndarray, tol: float) -> None:
        """The loss and gradient where it asked: go there if that is enough of a descent, else come closer."""
        if self.way is not None:
            if loss > self.loss + 1e-4 * self.step * float(self.slope @ self.way):
                self.step /= 2
                if self.step < 1e-6:
                    self.done = True
                return
            moved, turned = self.step * self.way, slope - self.slope
            if float(moved @ turned) > 1e-12:
                self.pairs = [*self.pairs, (moved, turned)][-self.memory :]
            self.at = self.at + moved
            self.done = self.loss - loss <= tol * max(abs(self.loss), 1e-12)
        self.loss, self.slope, self.step = loss, slope, 1.0
        q, kept = slope.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - float(y @ q) / float(s @ y))
        self.way = -q
        if not self.pairs:
            self.step = 1.0 / max(1.0, float(np.sqrt(q @ q)))
        if float(np.sqrt(slope @ slope)) < 1e-9:
            self.done = True


#: Terms of one slot of a gradient.
CHUNK = 1024


#: Rows that are multiplied at a time, as a dense block of the terms they hold: it fits in a cache.
ROWS = 64


def _dense(b: pa.RecordBatch, width: int, place: np.ndarray | None = None):
    """(rows, terms, block): slices of a batch, the places of the terms their rows hold, ascending, and the dense block of weights."""
    row, at = _entries(b.column("at"))
    at, x = at if place is None else place[at], np.asarray(b.column("x").flatten())
    ends = np.searchsorted(row, np.arange(0, b.num_rows + ROWS, ROWS))
    there, local = np.zeros(width, bool), np.zeros(width, np.int64)
    for i, lo in enumerate(range(0, b.num_rows, ROWS)):
        mine = slice(ends[i], ends[i + 1])
        there[at[mine]] = True
        terms = np.flatnonzero(there)
        there[terms] = False
        local[terms] = np.arange(len(terms))
        rows = slice(lo, min(lo + ROWS, b.num_rows))
        block = np.zeros((rows.stop - lo, len(terms)), np.float32)
        block[row[mine] - lo, local[at[mine]]] = x[mine]
        yield rows, terms, block


def _softmax(logits: np.ndarray, classes: int) -> np.ndarray:
    p = logits.reshape(len(logits), -1, classes)
    p = np.exp(p - p.max(axis=2, keepdims=True))
    return p / p.sum(axis=2, keepdims=True)


def logistic_grid(rows: DataFrame, classes: int, cs: list[float], width: int, among: np.ndarray | None = None, rounds: int = 60, tol: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients width x classes, intercepts) for each C, from rows (y: class number, w: weight, at, x).

    among: the terms that rows have, if that is known. Minimises the mean weighted log loss plus |coefficients|^2 / (2 C W), W the sum of weights:
    the usual C. A round is one scan for all C that still move; those that settle leave it.
    """
    total = rows.agg(F.sum("w").alias("w")).first().w
    if not total:
        raise ValueError("a classifier needs labelled rows")
    # terms that no row has keep coefficient 0: search among the others
    there = np.arange(width) if among is None else among
    place = np.full(width, -1, np.int64)
    place[there] = np.arange(len(there))
    size = len(there) * classes
    searches = [_Search(1.0 / (c * total), np.zeros(size + classes)) for c in cs]
    for _ in range(rounds):
        going = [s for s in searches if not s.done]
        if not going:
            break
        asked = [s.asks() for s in going]
        coef = np.concatenate([a[:size].reshape(len(there), classes) for a in asked], axis=1)
        bias = np.concatenate([a[size:] for a in asked])
        held = rows.sparkSession.sparkContext.broadcast((coef.astype(np.float32), bias, place))
        many = len(going)

        def run(batches, held=held, many=many):
            coef, bias, place = held.value
            gradient, rest = np.zeros(coef.shape), np.zeros(many + many * classes)
            for b in batches:
                if not b.num_rows:
                    continue
                every, weight = np.asarray(b.column("y")), np.asarray(b.column("w"))
                for rows, terms, block in _dense(b, len(coef), place):
                    y, w, at = every[rows], weight[rows], np.arange(rows.stop - rows.start)
                    p = _softmax((block @ coef[terms]).astype(np.float64) + bias, classes)
                    rest[:many] -= (w[:, None] * np.log(np.maximum(p[at, :, y], 1e-300))).sum(axis=0)
                    p[at, :, y] -= 1
                    wrong = (p * w[:, None, None]).reshape(len(y), -1)
                    rest[many:] += wrong.sum(axis=0)
                    gradient[terms] += block.T @ wrong.astype(np.float32)
            out = {i: gradient[i * CHUNK : (i + 1) * CHUNK].ravel() for i in range(-(-len(gradient) // CHUNK))}
            yield _slots(out | {-1: rest})

        got = _added(rows.mapInArrow(run, "slot long, x array<double>"))
        held.unpersist()
        chunks = [got[i] for i in range(-(-len(there) // CHUNK))]
        gradient = (np.concatenate(chunks) if chunks else np.zeros(0)).reshape(len(there), many * classes) / total
        rest = got[-1] / total
        for i, s in enumerate(going):
            own = np.ascontiguousarray(gradient[:, i * classes : (i + 1) * classes]).ravel()
            flat = asked[i][:size]
            slope = np.concatenate((own + s.penalty * flat, rest[many + i * classes : many + (i + 1) * classes]))
            s.told(float(rest[i]) + 0.5 * s.penalty * float(flat @ flat), slope, tol)
    out = []
    for s in searches:
        coef = np.zeros((width, classes))
        coef[there] = s.at[:size].reshape(len(there), classes)
        out.append((coef, s.at[size:]))
    return out


@dataclass
class Classifier:
    """TF-IDF and balanced multinomial logistic regression."""

    labels: list[str]
    weights: Weights
    coef: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    c: float = 1.0
    dev_f1: dict[float, float] = field(default_factory=dict)

    def predicted(self, docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
        """keep and predicted; a row without known terms gets what the intercepts say. Ties go to the first label."""
        return _said(self.weights.of(hashed(docs, terms, *keep, width=len(self.weights.idf))), self.coef, self.bias, self.labels, ["predicted"])


def _said(rows: DataFrame, coef: np.ndarray, bias: np.ndarray, labels: list[str], names: list[str]) -> DataFrame:
    """rows without at and x, with a label for each block of columns of coef."""
    held = rows.sparkSession.sparkContext.broadcast((coef.astype(np.float32), bias))
    keep = [f for f in rows.schema.fields if f.name not in ("at", "x")]

    def run(batches):
        coef, bias = held.value
        for b in batches:
            logits = [block @ coef[terms] + bias for _, terms, block in _dense(b, len(coef))]
            p = np.concatenate([*logits, np.zeros((0, len(bias)))]).reshape(b.num_rows, -1, len(labels)).argmax(axis=2)
            said = [pa.array([labels[i] for i in p[:, k]], pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *said], names=[*[f.name for f in keep], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(run, ", ".join(x for x in (fields, *[f"{n} string" for n in names]) if x))


def tuned(train: DataFrame, dev: DataFrame, terms: Column, label: str, grid: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0, 10.0), width: int = WIDTH) -> Classifier:
    """The classifier of the best macro F1 on dev, ties to the smaller C; rows without a label take no part.

    The whole grid is fitted in the same scans and judged in one pass over dev.
    """
    train, dev = train.where(F.col(label).isNotNull()), dev.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("string")).count().collect()}  # a row a label
    labels, n, cs = sorted(sizes), sum(sizes.values()), sorted(grid)
    if not labels:
        raise ValueError("a classifier needs labelled rows")
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")).cast("int") - 1
    balance = F.element_at(F.array(*[F.lit(n / (len(labels) * sizes[x])) for x in labels]), y + 1)
    counted = _for_scans(hashed(train.select("*", y.alias("y"), balance.alias("w")), terms, "y", "w", width=width))
    weights = term_weights(counted, width=width)
    rows = _for_scans(weights.of(counted))
    models = logistic_grid(rows, len(labels), cs, width, np.flatnonzero(weights.idf))
    coef, bias = np.concatenate([m[0] for m in models], axis=1), np.concatenate([m[1] for m in models])
    names = [f"c{i}" for i in range(len(cs))]
    said = _said(weights.of(hashed(dev.select("*", F.col(label).cast("string").alias("__gold")), terms, "__gold", width=width)), coef, bias, labels, names)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("said")) for i, c in enumerate(names)])
    counts = said.groupBy("__gold", *names).count().select("__gold", "count", F.explode(each).alias("e")).groupBy("e.i", "__gold", "e.said").agg(F.sum("count").alias("n")).collect()  # C x labels^2 rows
    f1: dict[float, float] = {}
    for i, c in enumerate(cs):
        mine = [(r["__gold"], r.said, r.n) for r in counts if r.i == i]
        golds = sorted({g for g, _, _ in mine})
        score = lambda t: 2 * sum(n for g, s, n in mine if g == s == t) / max(1, sum(n for g, _, n in mine if g == t) + sum(n for _, s, n in mine if s == t))
        f1[c] = sum(map(score, golds)) / max(1, len(golds))
    best = max(cs, key=lambda c: (round(f1[c], 12), -c))
    at = cs.index(best)
    return Classifier(labels, weights, *models[at], best, f1)
