"""A BM25 search index that is built once, saved as bucketed tables and asked many times; exact top k with pruning.

Postings stand in *impact-ordered blocks*: a block has postings of one term that are of one impact level,
and the largest weight among them. A level is split into chunks by a hash of the document, so
no block grows with its term.

A search has three steps, each exact in what it leaves out:

1. *Threshold.* The blocks of each term's highest level give first sums; the exact scores of
   the best of them are a lower bound of the query's k-th score.
2. *Essential terms.* Terms are taken from the commonest on as long as their largest possible
   contributions add up to less than ``SHARE`` of the threshold. A document that holds only
   such terms cannot reach the top k, so none of their blocks is joined, and of the term at the
   border only blocks whose maximum exceeds what is left of the share.
3. *Verification.* Of the documents met, those whose sum and all that was left out could still
   reach the threshold get their exact score: left-out terms are looked up by (term, document).

Saved tables: ``<name>_blocks`` bucketed by term, ``<name>_weights`` by term and document,
``<name>_terms`` by term. A search of a loaded index exchanges its queries and what they
meet, never a table of the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.operators import graph
from turnstone.operators.retrieval import B, K1, dot, every_score, top_k

#: Postings of a term for each chunk of its levels, on average; a block has at most about as many.
BLOCK = 1024
#: Impact levels a unit of a weight without its idf, which lies between 0 and K1 + 1.
LEVELS = 8
#: Share of the threshold that skipped terms may add up to. More skips more blocks, less leaves fewer documents to verify.
SHARE = 0.35
#: Scores are rounded to so many digits before they are ranked, so the order of addition breaks no ties.
DIGITS = 6
#: Query terms that are sent to every task; more of them are exchanged to the buckets of the index.
SMALL = 50_000
#: Rows (q, k, term) of a lookup that are sent to every task, some 50 bytes each.
PAIRS = 300_000
#: What rounding may move a score by; a threshold gives way by so much.
SLIP = 2 * 10.0**-DIGITS


@dataclass
class Index:
    """blocks (term, top, postings), weights (term, k, weight), terms (term, df, top, level)."""

    blocks: DataFrame
    weights: DataFrame
    terms: DataFrame

    def save(self, name: str, buckets: int | None = None) -> None:
        """Write the tables of the index, bucketed and sorted, in place of earlier ones of this name."""
        n = buckets or int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for table, by in (("blocks", ["term"]), ("weights", ["term", "k"]), ("terms", ["term"])):
            df: DataFrame = getattr(self, table)
            # dealt by bucket first, so that a bucket is one file and its sorting is known to hold
            df.repartition(n, *by).write.mode("overwrite").bucketBy(n, *by).sortBy(*by).format("parquet").saveAsTable(f"{name}_{table}")


def loaded(spark: SparkSession, name: str) -> Index:
    return Index(*[spark.table(f"{name}_{t}") for t in ("blocks", "weights", "terms")])


def indexed(corpus: DataFrame, key: str, terms: Column, *, only: DataFrame | None = None) -> Index:
    """The index of corpus; terms is an array of each document's terms, read once.

    only (term): an index for one set of queries has just their terms; frequencies and lengths
    are those of all. Documents without terms count for the mean length, null keys do not take
    part. Keys are taken to be distinct.
    """
    here = corpus.where(F.col(key).isNotNull())
    # a generator keeps the terms from being worked out twice; a document's row without a term counts it and its length
    docs = here.select(F.col(key).alias("k"), F.explode(F.array(F.coalesce(terms, F.array().cast("array<string>")))).alias("ts"))
    long = docs.select("k", F.size("ts").cast("long").alias("len"), F.explode(F.concat("ts", F.array(F.lit(None).cast("string")))).alias("term"))
    if only is not None:
        asked = graph.saved(only.select("term").distinct())
        asked = F.broadcast(asked) if asked.limit(SMALL + 1).count() <= SMALL else asked
        long = long.join(asked.withColumn("asked", F.lit(True)), "term", "left").where("asked or term is null")
    long = graph.written(long.groupBy("k", "term").agg(F.count("*").alias("tf"), F.any_value("len").alias("len")))
    words, n = (float(x or 0) for x in long.where("term is null").agg(F.sum(F.col("len") * F.col("tf")), F.sum("tf")).first())
    mean, long = max(words / max(n, 1.0), 1e-300), long.where("term is not null")
    df = graph.saved(long.groupBy("term").agg(F.count("*").alias("df")))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = long.join(_sized(df), "term").select("term", "k", "df", (idf * impact).alias("weight"), F.floor(impact * LEVELS).cast("int").alias("level"))
    chunk = F.pmod(F.xxhash64("k"), F.ceil(F.col("df") / BLOCK)).alias("chunk")
    blocks = graph.written(weights.groupBy("term", "level", chunk).agg(F.max("weight").alias("top"), F.collect_list(F.struct("k", "weight")).alias("postings"), F.any_value("df").alias("df")))
    vocabulary = graph.saved(blocks.groupBy("term").agg(F.any_value("df").alias("df"), F.max("top").alias("top"), F.max("level").alias("level")))
    return Index(blocks.select("term", "level", "top", "postings"), blocks.select("term", F.explode("postings").alias("p")).select("term", "p.k", "p.weight"), vocabulary)


def _asked(index: Index, queries: DataFrame, key: str, terms: Column) -> DataFrame:
    """q, term, qtf, df, most (the largest contribution), level: the queries' terms that the index knows."""
    q = queries.select(F.col(key).alias("q"), F.explode(terms).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    return graph.saved(q.join(index.terms, "term").select("q", "term", "qtf", "df", "level", (F.col("qtf") * F.col("top")).alias("most")))


def _sized(side: DataFrame, most: int | None = None) -> DataFrame:
    """A saved side with a broadcast hint if it is small."""
    most = SMALL if most is None else most
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def _met(asked: DataFrame, index: Index, wanted: Column) -> DataFrame:
    """q, k, c and border, if asked has it: contributions of the wanted blocks."""
    more = ["border"] if "border" in asked.columns else []
    a, b = _sized(asked).alias("a"), index.blocks.alias("b")
    rows = a.join(b, (F.col("a.term") == F.col("b.term")) & wanted).select("q", "qtf", *more, F.explode("postings").alias("p"))
    return rows.select("q", F.col("p.k").alias("k"), (F.col("qtf") * F.col("p.weight")).alias("c"), *more)


def _looked_up(pairs: DataFrame, index: Index) -> DataFrame:
    """q, k, more: what pairs (q, k, term, qtf) add up to."""
    pairs, weights = graph.saved(pairs), index.weights
    side = _sized(pairs, PAIRS)
    if side is pairs:  # too many to send: at least only postings of their documents are exchanged
        docs = graph.saved(pairs.select("k").distinct())
        weights = weights.join(_sized(docs, PAIRS), "k", "left_semi") if docs.limit(PAIRS + 1).count() <= PAIRS else weights
    return side.join(weights, ["term", "k"]).groupBy("q", "k").agg(F.sum(F.col("qtf") * F.col("weight")).alias("more"))


def thresholds(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """q, least: a lower bound of each query's k-th score; queries with fewer documents so far have none."""
    sums = _met(asked, index, F.col("b.level") == F.col("a.level")).groupBy("q", "k").agg(F.sum("c").alias("s"))
    return _kth(index, asked, sums, k)


def _kth(index: Index, asked: DataFrame, sums: DataFrame, k: int) -> DataFrame:
    """q, least: the k-th of the exact scores of each query's best documents by sums (q, k, s)."""
    best = top_k(sums, "q", "k", "s", 4 * k).select("q", "k")
    exact = _looked_up(best.join(asked.select("q", "term", "qtf"), "q"), index)
    kth = exact.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("more")))).where(F.col("place") == k)
    return kth.select("q", F.col("more").alias("least"))


def contenders(index: Index, asked: DataFrame, k: int, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """The pairs (q, k, sure: the sum of essential terms) that can still reach the k-th score, and the terms (q, term, qtf) they lack.

    No document of a query's true top k is missing, ties included. The sums of the essential
    terms give a second, higher threshold.
    """
    common = Window.partitionBy("q").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)  # a row a term of the query
    plan = asked.join(thresholds(index, asked, k), "q", "left").withColumn("bound", F.coalesce("least", F.lit(0.0)) - SLIP).withColumn("upto", F.sum("most").over(common))
    left = F.lit(share) * F.col("bound") - (F.col("upto") - F.col("most"))  # of the share, before this term
    cut = F.when(left <= 0, 0.0).when(F.col("upto") <= share * F.col("bound"), F.lit(None)).otherwise(left)  # null: not joined; above 0: the border
    plan = graph.saved(plan.withColumn("cut", cut))
    met = _met(plan.where("cut is not null").select("q", "term", "qtf", "cut", (F.col("cut") > 0).alias("border")), index, F.col("a.qtf") * F.col("b.top") >= F.col("a.cut"))
    sure = F.when(~F.col("border"), F.col("c")).otherwise(0.0)
    sums = graph.written(met.groupBy("q", "k").agg(F.sum("c").alias("s"), F.sum(sure).alias("sure")))
    slack = plan.groupBy("q").agg(F.sum(F.when(F.col("cut").isNull(), F.col("most")).otherwise(F.col("cut"))).alias("slack"))
    limits = slack.join(_kth(index, asked, sums, k), "q", "left").select("q", (F.coalesce("least", F.lit(0.0)) - SLIP - F.col("slack")).alias("need"))
    near = sums.join(limits, "q").where("s >= need")
    return near.select("q", "k", "sure"), plan.where("cut is null or cut > 0").select("q", "term", "qtf")


def search(index: Index, queries: DataFrame, query_key: str, key: str, terms: Column, k: int) -> DataFrame:
    """query_key, key, bm25, rank of the k best documents of each query, ties to the smaller key. Queries without known terms have none."""
    if k < 1:
        raise ValueError("k must be positive")
    asked = _asked(index, queries, query_key, terms)
    near, lacks = contenders(index, asked, k)
    near = graph.saved(near)
    rest = _looked_up(near.select("q", "k").join(lacks, "q"), index)
    scored = near.join(rest, ["q", "k"], "left").select(F.col("q").alias(query_key), F.col("k").alias(key), F.round(F.col("sure") + F.coalesce("more", F.lit(0.0)), DIGITS).alias("bm25"))
    return top_k(scored, query_key, key, "bm25", k)


def searched(corpus: DataFrame, key: str, queries: DataFrame, query_key: str, terms: Column, k: int) -> DataFrame:
    """Rows like those of search() of a corpus without an index, for queries that are asked once.

    An index costs more than a search saves until it is asked again, so documents are scored where they
    lie and each partition sends its k best of a query. Documents without text (terms null) have no length.
    """
    return top_k(every_score(queries, query_key, corpus, key, terms, DIGITS), query_key, key, "bm25", k)


# ---- vectors and earlier answers ----


def save_vectors(vectors: DataFrame, key: str, column: str, name: str, buckets: int | None = None) -> None:
    """Unit vectors of a corpus as the table <name>_vectors, bucketed by key; vectors of no length are left out."""
    n = buckets or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.sqrt(dot(F.col(column), F.col(column)))
    unit = vectors.select(F.col(key).alias("k"), F.transform(column, lambda x: x.cast("double")).alias("v"), size.alias("size")).where("size > 0").select("k", F.transform("v", lambda x: x / F.col("size")).alias("v"))
    unit.repartition(n, "k").write.mode("overwrite").bucketBy(n, "k").sortBy("k").format("parquet").saveAsTable(f"{name}_vectors")


class Answers:
    """Answers kept by query text in a table: a text that was asked before is not searched again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def _kept(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def ask(self, queries: DataFrame, query_key: str, key: str, find) -> DataFrame:
        """query_key, key, bm25, rank. find takes (text_id, text), different texts that have no answer yet, and returns their top rows.

        A text without results is kept too (a row without a document).
        """
        named = graph.saved(queries.select(query_key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_id"), F.coalesce("text", F.lit("")).alias("text")))
        kept = self._kept()
        new = named.select("text_id", "text").dropDuplicates(["text_id"])
        new = graph.saved(new if kept is None else new.join(kept.select("text_id"), "text_id", "left_anti"))
        if not new.isEmpty():
            found = find(new).select("text_id", key, "bm25", "rank")
            new.select("text_id").join(found, "text_id", "left").write.mode("append").format("parquet").saveAsTable(self.name)
            self.spark.catalog.refreshTable(self.name)
        return named.select(query_key, "text_id").join(self.spark.table(self.name), "text_id").where(F.col(key).isNotNull()).select(query_key, key, "bm25", "rank")
