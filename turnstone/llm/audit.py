"""Operator 11, filter interaction audit: subset-zeta transform.

What any order of filters removes depends only on how many documents fail which *set* of
filters. One pass gives each document the mask of the filters it fails; masks are counted
per part, with labelled losses beside them. A subset-sum (zeta) transform of the 2^n counts
of a part then has, for every filter subset, the documents that fail only filters in it; the
survivors of a subset are those that fail only filters outside it. Every step of every order
is a difference between two neighbouring subsets, so the n! orders cost nothing but their own
output rows; the same holds for labels. A Shapley sum weighs the differences of one filter
over all subsets without it by the orders that pass through them.

Repeated texts (rule E): rows of one document and text are counted together before anything
is joined. Then each text's smallest document is found by a ``min`` that is combined
on the map side: a text in a third of all rows costs one row a task. Texts are compared by a
128-bit digest and their length. Nothing but counts of masks (parts x 2^n) is ever in one place.

Cases: a null text is an empty one, a null part the empty string; a null doc_id counts as
larger than all others, so rows of null ids with one text pass rule E together unless another
document has it; rows that share doc_id and text are all counted and judged alike; of labels
that share a doc_id any 1 counts; documents without labels lose none. A table without rows
has no parts and gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LETTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_CONTINUES = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits of the rules A to D that a UTF-8 text fails; bit 0 is A."""
    words = text.split()  # bytes.split() takes 0x20 and 0x09-0x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUES))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * points, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(1 << i for i, f in enumerate(fails) if f)


def masked(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (rules A to D), digest of text: one pass without a shuffle, texts are dropped."""
    B.ready(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(B.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("body"))

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column("body").to_pylist()]
            mask = pa.array([text_mask(x) for x in texts], pa.int32())
            digest = pa.array([hashlib.blake2b(x, digest_size=16).digest() + len(x).to_bytes(5, "big") for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), mask, digest], names=["doc_id", "part", "mask", "digest"])

    return frame.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document, text and part: its number of rows, and whether it is labelled good or toxic.

    The join key tells null ids with different texts apart, so that they do not meet in one task.
    """
    key = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.hex("digest"))).alias("key")
    few = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")).select(key, "*")
    known = labels.where("doc_id is not null").groupBy(F.concat(F.lit("id "), F.col("doc_id").cast("long").cast("string")).alias("key"))
    marks = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return few.join(marks, "key", "left").select("key", "doc_id", "part", "mask", "digest", "n", none("good"), none("toxic"))


def mask_counts(rows: DataFrame, repeat_bit: int | None = None) -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the set of filters they fail.

    rows come from with_labels(). repeat_bit: the filter that fails if a smaller doc_id has
    the same text; its bit is added here. The first document of each text goes to bit 0 and
    all others, which are all rows less the first ones, to bit 1.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    weigh = lambda df: df.select("part", "mask", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    if repeat_bit is None:
        return weigh(rows).groupBy("part", "mask").agg(*sums)
    # rows of one document and text have one mask; they may have several parts
    each = B.saved(rows.groupBy("key", "digest").agg(F.first("doc_id").alias("doc_id"), F.first("mask").alias("mask"), F.first("good").alias("good"), F.first("toxic").alias("toxic"), F.collect_list(F.struct("part", "n")).alias("parts")))
    spread = lambda df: weigh(df.select("mask", "good", "toxic", F.explode("parts").alias("p")).select("p.part", "mask", "p.n", "good", "toxic"))
    whole = F.struct("mask", "good", "toxic", "parts")
    first = each.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", whole.alias("row"))).alias("s")).select("s.row.*")
    every = spread(each).groupBy("part", "mask").agg(*sums)
    kept = spread(first).groupBy("part", "mask").agg(*sums)
    # counts of masks from here on: parts x 2^n rows at most
    signed = lambda sign: [(sign * F.col(c)).alias(c) for c in ("n", "good", "toxic")]
    failed = F.col("mask").bitwiseOR(F.lit(1 << repeat_bit)).alias("mask")
    both = kept.unionByName(every.select("part", failed, *signed(1))).unionByName(kept.select("part", failed, *signed(-1)))
    return both.groupBy("part", "mask").agg(*sums).where("n > 0")


def _with_filter(sums: Column, bit: int) -> Column:
    """Sums over subsets of the filters so far, to which the filter of this bit is added."""
    without = lambda i: F.element_at(sums, i - bit + 1)
    return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) > 0, without(i)).otherwise(F.lit(0).cast("long")))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """part, exact, and for n, good and toxic an array that has at each filter subset the rows which pass all of it.

    exact has at each mask the rows that fail just these filters. One row a part of 2^filters
    numbers each.
    """
    at = lambda c, mask: F.coalesce(F.sum(F.when(F.col("mask") == mask, F.col(c))), F.lit(0)).cast("long")
    sums = counts.groupBy("part").agg(*[F.array(*[at(c, mask) for mask in range(1 << filters)]).alias(c) for c in ("n", "good", "toxic")])
    sums = sums.select("*", F.col("n").alias("exact"))
    for bit in range(filters):  # the zeta transform, one filter after another
        sums = B.saved(sums.select("part", "exact", *[_with_filter(F.col(c), 1 << bit).alias(c) for c in ("n", "good", "toxic")]))
    # the survivors of a subset fail filters of its complement only: the same array from its end
    return sums.select("part", "exact", *[F.reverse(c).alias(c) for c in ("n", "good", "toxic")])


def steps(per_part: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters and step, from survivors(): differences between neighbouring subsets.

    An order per permutation is written out, so this is for few filters; their number bounds the local table of orders.
    """
    k = len(letters)
    if k > 7:
        raise ValueError("more than 7 filters have too many orders to be listed")
    rows = []
    for order in itertools.permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, before, 1 << f))
            before |= 1 << f
    spark = per_part.sparkSession
    orders = F.broadcast(spark.createDataFrame(rows, "filter_order string, step int, before int, bit int"))
    at = lambda c, subset: F.element_at(c, subset + 1)
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda c: at(c, F.col("before")) - at(c, after)
    fails = at("n", F.lit(0)) - at("n", F.col("bit"))
    # a subset of s other filters stands before the filter in s! (k - 1 - s)! orders
    weight = F.array(*[F.lit(math.factorial(bin(s).count("1")) * math.factorial(max(0, k - 1 - bin(s).count("1")))).cast("long") for s in range(1 << k)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(F.col("bit")) == 0, F.element_at(weight, s + 1) * (at("n", s) - at("n", s + F.col("bit")))).otherwise(F.lit(0).cast("long")))
    # what a filter sums to over all orders does not depend on the order: once per part and filter
    per_filter = per_part.select("*", F.explode(F.array(*[F.lit(1 << i) for i in range(k)])).alias("bit")).withColumn("shapley", shapley)
    return per_filter.join(orders, "bit").select("part", "filter_order", "step", at("n", after).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"), at("exact", F.col("bit")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five text rules A to E in all 120 orders, for each part."""
    return steps(survivors(mask_counts(with_labels(masked(docs, part), labels), repeat_bit=4), len(LETTERS)))


def _sql() -> str:
    """Every document taken through every order, one by one: no subsets."""
    orders = ", ".join("('" + "".join(p) + "')" for p in itertools.permutations(LETTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > least THEN 'E' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
o AS (SELECT * FROM (VALUES {orders}) t(filter_order)),
s AS (SELECT part, filter_order, step, filter_order[step] AS f, fails, good, toxic, contains(fails, filter_order[step]) AS bad, len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone FROM f CROSS JOIN o CROSS JOIN range(1, 6) t(step)),
c AS (SELECT part, filter_order, step::INTEGER AS step, f, count(*) FILTER (NOT gone AND NOT bad) AS kept, count(*) FILTER (NOT gone AND bad) AS removed, count(*) FILTER (gone AND bad) AS redundant, count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (NOT gone AND bad AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND bad AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c"""


ORACLE = _sql()
