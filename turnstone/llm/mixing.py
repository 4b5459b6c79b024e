"""Operator 1, mixing sources to target weights: Poisson replication.

Each source has a mean repetition rate: its target weight of the output, over its own share
of the input, times ``epochs``. A document's count inverts the Poisson distribution of that
mean at a number hashed from seed and doc_id, so any executor finds the same count again.
A rate above ``STEP`` is cut into equal parts of at most that, each with a hashed number of its
own: sums of independent Poisson counts are Poisson, tables stay short, and the work for a
document grows with its number of copies.
Documents are exploded by their count and dealt out by a hash of seed, doc_id and copy.

Rates come from counts per source, a table of one row a source that is broadcast only
after its size is checked; a hot source costs nothing more than its own rows.

Cases: a null source is a source of its own; sources without a target get weight 0 (their
rows go) if targets are given; a null doc_id hashes as the text "null"; rows that share a
doc_id get the same count; null and empty texts are rows like any other. Empty tables give
empty results; columns named copy, rate or shuffle_key are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SEED = 42
#: Largest mean that is inverted in one draw.
STEP = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(count <= j) for j = 0, 1, ... until nothing measurable is left; logs keep it exact for large rates."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")
    step = lambda acc, j: F.struct(
        (acc["logp"] + F.ln(rate) - F.ln(j.cast("double"))).alias("logp"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["logp"] + F.ln(rate) - F.ln(j.cast("double"))))).alias("cdf"),
    )
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, epochs: float = 1.0, by: str = "source") -> DataFrame:
    """key, rate, cdf: one row a source. Without targets all sources weigh the same."""
    counts = docs.groupBy(B.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        pairs = [x for k, w in targets.items() for x in (F.lit(k), F.lit(float(w)))]
        weighed = counts.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("key")], F.lit(0.0)) if pairs else F.lit(0.0))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.when(F.col("all_weight") > 0, F.lit(epochs) * F.col("weight") * F.col("all_n") / (F.col("all_weight") * F.col("n"))).otherwise(0.0)
    out = weighed.join(F.broadcast(total)).select("key", rate.alias("rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    return out.withColumn("draws", draws).withColumn("cdf", F.when(F.col("rate") > 0, poisson_cdf(F.col("rate") / F.col("draws"))).otherwise(F.array(F.lit(1.0))))


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, *, epochs: float = 1.0, seed: int = SEED, by: str = "source", partitions: int | None = None) -> DataFrame:
    """docs repeated or left out by source, in a global random order; rate, copy (from 1) and shuffle_key are new."""
    return B.shielded(docs, ("doc_id", by), ("copy", "rate", "shuffle_key"), lambda d: _mixed(d, targets, epochs, seed, by, partitions))


def _mixed(docs: DataFrame, targets: dict[str, float] | None, epochs: float, seed: int, by: str, partitions: int | None) -> DataFrame:
    table = B.checked_side(rates(docs, targets, epochs, by))
    side = table.select(F.col("key").alias("_key"), F.col("rate").alias("_rate"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf"))
    below = lambda u: F.size(F.filter("_cdf", lambda c: c <= u))
    draw = lambda i: F.when(i == 0, uniform(F.lit(seed), F.col("doc_id"))).otherwise(uniform(F.lit(seed), F.col("doc_id"), i))
    count = F.aggregate(F.sequence(F.lit(0), F.col("_draws") - 1), F.lit(0), lambda n, i: n + below(draw(i)))
    copies = (
        docs.join(side, B.col(by).eqNullSafe(F.col("_key")))
        .withColumn("_count", count)
        .where("_count > 0")
        .select(*[B.col(c) for c in docs.columns], F.col("_rate").alias("rate"), F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
        .withColumn("shuffle_key", uniform(F.lit(seed + 1), F.col("doc_id"), F.col("copy")))
    )
    dealt = copies.repartition(partitions, "shuffle_key") if partitions else copies.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")


ORACLE = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * 1.0::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE / ((SELECT count(*) FROM counts)::DOUBLE * n) AS rate FROM counts),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INTEGER AS draws, rate / greatest(1, ceil(rate / 16.0)) AS part FROM rates),
cdf AS (
  SELECT source, part, 0 AS j, -part AS logp, exp(-part) AS c FROM parts
  UNION ALL
  SELECT source, part, j + 1, logp + ln(part) - ln((j + 1)::DOUBLE), c + exp(logp + ln(part) - ln((j + 1)::DOUBLE))
  FROM cdf WHERE j < ceil(part + 12 * sqrt(part) + 12)
),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null') || CASE WHEN i = 0 THEN '' ELSE ':' || i::VARCHAR END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT d.*, r.rate, unnest(range(r.draws)) AS i FROM {docs} d JOIN parts r ON r.source IS NOT DISTINCT FROM d.source) d
),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, rate, sum(k)::BIGINT AS k
  FROM (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS k FROM drawn d)
  GROUP BY doc_id, text, lang, source, n_chars, rate
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copy::INTEGER AS copy,
       ('0x' || substr(md5('43:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS shuffle_key
FROM (SELECT *, unnest(range(1, k + 1)) AS copy FROM counted)
"""
