"""Rankings, splits, samples and statistics over case and score tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import values as V
from turnstone.operators import graph

POOL, DEV = 0.10, 0.25


def _running(counts: DataFrame, value: str) -> DataFrame:
    """counts (one row a distinct number in value, with __n) with __upto, the rows up to and with it, and __all.

    Values are cut into ranges at approximate quantiles; windows run within ranges, side by
    side, and only the ranges' totals are added up in one place, a row for each.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    of = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(value)))
    cut = counts.withColumn("__range", of)
    totals = cut.groupBy("__range").agg(F.sum("__n").alias("__t"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("__upto", F.sum("__n").over(inside)).join(F.broadcast(starts), "__range")  # a row a range
    return run.withColumn("__upto", F.col("__upto") + F.col("__before")).drop("__range", "__before")


def percent_rank_avg(df: DataFrame, columns: list[str], prefix: str = "pct_") -> DataFrame:
    """(rank + (ties - 1) / 2) / n of each numeric column, ascending; ties share the average rank.

    Counts per value are ranked, not rows, in ranges that run side by side.
    """
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
        ranks = _running(counts, c).select(c, ((F.col("__upto") - F.col("__n") + 1 + (F.col("__n") - 1) / 2.0) / F.col("__all")).alias(prefix + c))
        df = df.join(ranks, c, "left")
    return df


def weighted_ranking(df: DataFrame, weights: dict[str, float], eligible: Column, tie: list[Column], falling: tuple[str, ...] = ()) -> DataFrame:
    """score (weighted mean of percentile ranks among eligible rows) and place (eligible rows only)."""
    use = df.withColumn("eligible", eligible)
    ranked = percent_rank_avg(use.where("eligible").withColumns({f"__{c}": (-F.col(c) if c in falling else F.col(c)) for c in weights}), [f"__{c}" for c in weights], "pct")
    total = float(sum(weights.values()))
    score = sum((F.col(f"pct__{c}") * w for c, w in weights.items()), F.lit(0.0)) / total
    ranked = ranked.withColumn("score", F.round(score, 9))  # else the order of addition would break ties
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), *tie)))
    rest = use.where("not eligible").withColumns({"score": F.lit(None).cast("double"), "place": F.lit(None).cast("int")})
    return ranked.select(*rest.columns).unionByName(rest)


def normalized_entropy(df: DataFrame, by: str, label: str, kinds: int, leave_out: str | None = "other") -> DataFrame:
    counts = df.where(F.col(label) != leave_out if leave_out else F.lit(True)).groupBy(by, label).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return df.select(by).distinct().join(shares.groupBy(by).agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(float(kinds)))).alias("entropy")), by, "left").select(by, F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def provisional_split(group: Column, seed: int = 42) -> Column:
    u = V.hash_fraction(V.seeded(seed, group))
    return F.when(u < POOL, "pool").when(u < DEV, "dev").otherwise("train")


def tune_or_test(key: Column, seed: int = 42) -> Column:
    return F.when(V.hash_fraction(V.seeded(seed, key), 8, closed=True) < 0.5, "tune").otherwise("test")


def hash_place(key: Column, by: list[str], seed: int = 42) -> Column:
    """Place (from 1) in seeded hash order, within groups."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(V.seeded(seed, key), 256)))


def stratum_weights(population: DataFrame, sample: DataFrame, by: str) -> DataFrame:
    share = lambda df, name: df.groupBy(by).agg(F.count("*").alias("__n")).select(by, (F.col("__n") / F.sum("__n").over(Window.partitionBy())).alias(name))
    return share(population, "population_share").join(share(sample, "sample_share"), by).withColumn("weight", F.col("population_share") / F.col("sample_share"))


def quotas(counts: DataFrame, by: str, n: int, least: int = 1) -> DataFrame:
    """by, quota: proportional to n with a floor, at most what there is; the rest by largest remainder, then name.

    counts has one row a stratum.
    """
    w = Window.partitionBy()
    share = counts.withColumn("__x", F.lit(float(n)) * F.col("n") / F.sum("n").over(w))
    base = share.withColumn("__q", F.least(F.col("n"), F.greatest(F.lit(least), F.floor("__x"))))
    left = base.withColumn("__left", F.lit(n) - F.sum("__q").over(w)).withColumn("__place", F.row_number().over(Window.orderBy(F.desc(F.when(F.col("n") > F.col("__q"), F.col("__x") - F.col("__q"))), by)))
    extra = (F.col("__place") <= F.col("__left")) & (F.col("n") > F.col("__q"))
    return left.select(by, (F.col("__q") + extra.cast("int")).cast("int").alias("quota"))


def topped_up(wanted: DataFrame, counts: DataFrame, by: str, target: int) -> DataFrame:
    """by, quota: the wanted quotas (by, quota, priority) as far as there are rows (counts: by, n), and what is missing to target dealt in turn by priority to strata with rows to spare.

    Both tables have one row a stratum; a stratum without a wish comes after all others, by name.
    """
    w = Window.partitionBy()
    base = counts.join(wanted, by, "left").select(by, "n", "priority", F.least("n", F.coalesce("quota", F.lit(0))).cast("long").alias("__q"))
    base = base.withColumn("__missing", F.greatest(F.lit(0), F.lit(target) - F.sum("__q").over(w)))
    spare = base.select(by, "priority", "__missing", F.explode(F.when((F.col("n") > F.col("__q")) & (F.col("__missing") > 0), F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("__q"), "__missing")))).alias("turn"))
    dealt = spare.withColumn("__place", F.row_number().over(Window.orderBy("turn", F.asc_nulls_last("priority"), by))).where(F.col("__place") <= F.col("__missing"))  # target rows a stratum at most
    return base.join(dealt.groupBy(by).agg(F.count("*").alias("__more")), by, "left").select(by, (F.col("__q") + F.coalesce("__more", F.lit(0))).cast("int").alias("quota"))


def stratified(df: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """Up to each stratum's quota in hash order; quotas are a small table, rows are ranked within strata."""
    q = quotas(df.groupBy(by).agg(F.count("*").alias("n")), by, n)
    return df.withColumn("place", hash_place(F.col(key), [by], seed)).join(q, by).where("place <= quota")


def round_robin(df: DataFrame, key: str, by: list[str], n: int, seed: int = 42) -> DataFrame:
    """The first n rows taking one of each group in turn, groups by name, rows in hash order."""
    return df.withColumn("turn", hash_place(F.col(key), by, seed)).orderBy("turn", *by).limit(n)


def diverse_sample(df: DataFrame, key: str, dimensions: list[str], n: int, seed: int = 42, heap: int = 1000) -> DataFrame:
    """Greedy: each step takes a row of the combination of levels that is furthest below target (targets ~ root of counts), ties to the larger names.

    How far a combination is below target only falls while rows are taken, so what it was once
    bounds what it is (lazy greedy). The driver holds the best ``heap`` combinations as of the
    last look and what it has taken since, n rows at most; as long as its best one is above the
    last of them at that look, no other can be better. Else all combinations are weighed anew,
    side by side, and the best ``heap`` fetched. No number of combinations is too many.
    """
    counts = graph.saved(df.groupBy(*dimensions).agg(F.count("*").alias("__n")))
    combos, total = counts, counts.agg(F.sum("__n")).first()[0] or 0
    name = lambda d: F.coalesce(F.col(d).cast("string"), F.lit(""))
    for i, d in enumerate(dimensions):
        levels = counts.groupBy(d).agg(F.sum("__n").alias("__m"))
        scale = levels.agg(F.sum(F.sqrt("__m")).alias("__s"))  # one row
        target = levels.crossJoin(F.broadcast(scale)).select(F.col(d).alias(f"__l{i}"), F.greatest(F.lit(1.0), n * F.sqrt("__m") / F.col("__s")).alias(f"__t{i}"))
        combos = combos.join(target, F.col(d).eqNullSafe(F.col(f"__l{i}")))
    combos = graph.saved(combos.select(*dimensions, "__n", *[f"__t{i}" for i in range(len(dimensions))]))
    spark, types = df.sparkSession, dict(df.dtypes)
    taken: list[dict] = [{} for _ in dimensions]
    quota: dict[tuple, int] = {}

    def look() -> list:
        """The best combinations with rows left, best first."""
        now = combos
        for i, d in enumerate(dimensions):
            had = spark.createDataFrame([(v, float(k)) for v, k in taken[i].items()], f"`__h{i}` {types[d]}, `__k{i}` double")  # n rows at most
            now = now.join(F.broadcast(had), F.col(d).eqNullSafe(F.col(f"__h{i}")), "left")
        spent = spark.createDataFrame([(*c, q) for c, q in quota.items()], ", ".join([*[f"`__q{i}` {types[d]}" for i, d in enumerate(dimensions)], "__q long"]))  # n rows at most
        now = now.join(F.broadcast(spent), [F.col(d).eqNullSafe(F.col(f"__q{i}")) for i, d in enumerate(dimensions)], "left").where(F.col("__n") > F.coalesce("__q", F.lit(0)))
        need = sum((1 - F.coalesce(f"__k{i}", F.lit(0.0)) / F.col(f"__t{i}") for i in range(len(dimensions))), F.lit(0.0))
        return now.withColumn("__need", F.round(need, 9)).orderBy(F.desc("__need"), *[F.desc(name(d)) for d in dimensions]).limit(heap).collect()

    def rank(r) -> tuple:
        need = sum(1 - taken[i].get(r[d], 0) / r[f"__t{i}"] for i, d in enumerate(dimensions))
        return round(need, 9), tuple("" if r[d] is None else _text(r[d]) for d in dimensions)

    held, least = [], None
    for _ in range(min(n, total)):
        left = [r for r in held if quota.get(tuple(r[d] for d in dimensions), 0) < r["__n"]]
        best = max(left, key=rank, default=None)
        if best is None or (least is not None and rank(best) < least):
            held = look()
            least = rank(held[-1]) if len(held) == heap else None
            best = max(held, key=rank)
        at = tuple(best[d] for d in dimensions)
        quota[at] = quota.get(at, 0) + 1
        for i, d in enumerate(dimensions):
            taken[i][best[d]] = taken[i].get(best[d], 0) + 1
    schema = ", ".join(f"`{d}` {types[d]}" for d in dimensions) + ", __quota int"
    side = spark.createDataFrame([(*c, q) for c, q in quota.items()], schema)
    same = [F.col(f"l.{d}").eqNullSafe(F.col(f"r.{d}")) for d in dimensions]
    few = df.alias("l").join(F.broadcast(side).alias("r"), same).select("l.*", "__quota")  # only rows of chosen combinations are ranked
    return few.withColumn("__place", hash_place(F.col(key), dimensions, seed)).where("__place <= __quota").drop("__place", "__quota")


def _text(value) -> str:
    """A level as Spark writes it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def split_assignments(cases: DataFrame, groups: DataFrame, golden: DataFrame, seed: int = 42) -> DataFrame:
    """case_id, split, reason: the golden pick leaves the pool, then duplicates of golden openers and sharers of golden messages leave train and dev.

    cases: case_id, opener_key, message_ids; groups: case_id, group_id; golden: case_id.
    """
    base = cases.join(groups, "case_id").join(golden.select("case_id", F.lit(True).alias("__g")), "case_id", "left")
    base = base.withColumn("split", F.when(F.col("__g"), "golden").otherwise(provisional_split(F.col("group_id"), seed))).withColumn("split", F.when(F.col("split") == "pool", "reserve").otherwise(F.col("split")))
    gold = base.where("split = 'golden'")
    openers = gold.where("opener_key <> ''").select("opener_key").distinct().withColumn("__dup", F.lit(True))
    ids = gold.select(F.explode("message_ids").alias("m")).distinct()
    shared = base.select("case_id", F.explode("message_ids").alias("m")).join(ids, "m", "left_semi").select("case_id").distinct().withColumn("__shared", F.lit(True))
    out = base.join(openers, "opener_key", "left").join(shared, "case_id", "left")
    reason = F.when(~F.col("split").isin("train", "dev"), "").when(F.col("__dup"), "duplicate_opener_of_golden").when(F.col("__shared"), "shares_message_with_golden").otherwise("")
    return out.select("case_id", F.when(reason != "", "excluded").otherwise(F.col("split")).alias("split"), reason.alias("reason"))


def leakage(assignments: DataFrame, columns: list[str]) -> DataFrame:
    """column, shared: how many values of each column golden rows share with train and dev rows."""
    out = None
    for c in columns:
        gold, rest = assignments.where("split = 'golden'").select(c), assignments.where("split in ('train', 'dev')").select(c)
        one = gold.where(F.col(c).isNotNull()).distinct().join(rest, c, "left_semi").agg(F.count("*").alias("shared")).select(F.lit(c).alias("column"), "shared")
        out = one if out is None else out.unionByName(one)
    return out


# ---- statistics over labels ----


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of labels present in gold; empty denominators give 0."""
    m = confusion(df, gold, predicted)
    hit = m.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = m.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    r = hit.join(said, "label", "left").na.fill(0, ["said"])
    p, c = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return r.select("label", "support", p.alias("precision"), c.alias("recall"), F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)).alias("f1"))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """One row: the commonest label, ties by name."""
    return df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed, expected, kappa (null if expected agreement is 1)."""
    m = confusion(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows, cols = m.groupBy("gold").agg(F.sum("n").alias("r")), m.groupBy("predicted").agg(F.sum("n").alias("c"))
    both = rows.join(cols, F.col("gold") == F.col("predicted")).agg(F.sum(F.col("r") * F.col("c")).alias("e"))
    one = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("o")).crossJoin(F.broadcast(both))  # one row each
    po, pe = F.col("o") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    return one.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: quadratic-weighted kappa of integer ratings, from marginal sums (no grid of pairs).

    The expected squared distance of independent ratings is E[a2] + E[b2] - 2 E[a] E[b]. Null
    only if both raters use one and the same label; 0 if one rater is constant.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg((x - y) * (x - y)).alias("o"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.avg(x * x).alias("sa"), F.avg(y * y).alias("sb"), F.avg((x == y).cast("int")).alias("exact"), F.avg(F.abs(x - y)).alias("mean_abs_diff"))
    e = F.col("sa") + F.col("sb") - 2 * F.col("ma") * F.col("mb")
    return s.select("n", "exact", "mean_abs_diff", F.when(F.abs(e) > 1e-12, 1 - F.col("o") / e).alias("kappa"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation with average ranks; null if a column is constant."""
    r = percent_rank_avg(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("ra"), F.col(b).alias("rb")), ["ra", "rb"])
    spread = F.stddev_pop("pct_ra") * F.stddev_pop("pct_rb")
    return r.agg(F.count("*").alias("n"), F.when(spread > 1e-15, F.try_divide(F.covar_pop("pct_ra", "pct_rb"), spread)).alias("rho"))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labelings."""
    m = confusion(df, a, b)
    row, col = m.groupBy("gold").agg(F.sum("n").alias("r")), m.groupBy("predicted").agg(F.sum("n").alias("c"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    n = m.agg(F.sum("n").cast("double").alias("total"), pairs("n").alias("ij"))
    whole, every = F.broadcast(n.select("total")), F.col("total")  # one row
    info = m.join(row, "gold").join(col, "predicted").crossJoin(whole).agg(F.sum(F.col("n") / every * F.ln(F.col("n") * every / (F.col("r") * F.col("c")))).alias("mi"))
    ent = lambda df, c: df.crossJoin(whole).agg(pairs(c).alias(f"p{c}"), (-F.sum(F.col(c) / every * F.ln(F.col(c) / every))).alias(f"h{c}"))
    one = n.crossJoin(F.broadcast(info)).crossJoin(F.broadcast(ent(row, "r"))).crossJoin(F.broadcast(ent(col, "c")))  # one row each
    expected = F.col("pr") * F.col("pc") / (every * (every - 1) / 2)
    most = (F.col("pr") + F.col("pc")) / 2
    return one.select(every.cast("long").alias("n"), F.when(most != expected, (F.col("ij") - expected) / (most - expected)).otherwise(1.0).alias("ari"), F.when(F.col("hr") + F.col("hc") > 0, 2 * F.col("mi") / (F.col("hr") + F.col("hc"))).otherwise(1.0).alias("nmi"))


#: The Poisson(1) distribution function at 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap_interval(df: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean and the 2.5 and 97.5 percentiles of Poisson-bootstrap means; weights hashed from (round, key). A round that draws no row has no mean.

    Every row becomes one vector, its weight and weighted value in each round; vectors are added
    up by one aggregate that is combined on the map side, so rows are neither repeated nor
    shuffled: each task sends one vector. Null values take no part.
    """
    said = lambda r: F.concat_ws(":", F.lit(str(seed)), r.cast("string"), F.col(key).cast("string"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.conv(F.substring(F.md5(said(r)), 1, 13), 16, 10).cast("double") / float(1 << 52))
    weights = F.transform(draws, lambda u: sum(((u >= c).cast("double") for c in POISSON), F.lit(0.0)))
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.explode(F.array(weights)).alias("w"))
    vector = rows.select(array_to_vector(F.concat("w", F.transform("w", lambda w: w * F.col("v")))).alias("x"))
    none = df.sparkSession.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), 2 * rounds)).alias("x"))  # so that there is a sum without rows
    total = vector.unionByName(none).agg(vector_to_array(Summarizer.sum(F.col("x"))).alias("t"))  # rounds numbers twice
    mean = F.zip_with(F.slice("t", 1, rounds), F.slice("t", rounds + 1, rounds), lambda n, s: F.try_divide(s, n))
    means = total.select(F.explode(mean).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
