"""Vocabularies of words and word pairs: exact document frequencies of what is frequent enough.

Words and pairs are counted in one pass over the texts, added up on the map side first. Where most
pairs are rare and the least frequency is high, they can be sketched before (`width`): every pair of a
document counts in one bucket of each of a few hash tables of that width, which never count too little, and
a pair goes on only if all of its buckets reach the least frequency; the exact counts drop what shares
buckets with frequent ones. Results are the same. A sketch is a second pass with `tables` rows a pair, so it
pays only where few buckets are heavy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import graph
from turnstone.operators.retrieval import bigrams, top_k

#: Rows that are broadcast (heavy buckets of a hash table, words of a vocabulary), and hash tables.
WIDTH, TABLES = 1 << 20, 2


def _bucket(term: Column, table: int, width: int) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(table)), F.lit(width))


def heavy_buckets(seen: DataFrame, least: int, width: int = WIDTH, tables: int = TABLES) -> DataFrame:
    """table, bucket of the buckets that `least` or more rows of seen (term) fall into, saved."""
    places = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), _bucket(F.col("term"), t, width).alias("bucket")) for t in range(tables)])).alias("p")
    return graph.saved(seen.select(places).groupBy("p.table", "p.bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("table", "bucket"))


def proposed(seen: DataFrame, heavy: DataFrame, width: int = WIDTH, tables: int = TABLES) -> DataFrame:
    """Rows of seen whose term falls into heavy buckets of all tables."""
    for t in range(tables):
        mine = heavy.where(F.col("table") == t).select(F.col("bucket").alias(f"__b{t}"))
        seen = seen.join(F.broadcast(mine), _bucket(F.col("term"), t, width) == F.col(f"__b{t}"), "left_semi")  # width rows at most
    return seen


def gram_vocabulary(docs: DataFrame, tokens: Column, *, pairs: bool = True, min_df: int = 5, max_df: float = 0.4, width: int | None = None, tables: int = TABLES) -> DataFrame:
    """term, df, idf of the words, and pairs of neighbouring words, that are in min_df documents or more and in at most a share of max_df of all.

    idf = ln((1 + n) / (1 + df)) + 1. Null texts are documents without words.
    """
    kept = docs.select(F.explode(F.array(F.coalesce(tokens, F.array().cast("array<string>")))).alias("ts"))  # a generator keeps the terms from being worked out twice
    kept = kept if width is None else graph.written(kept)  # a sketch reads it twice
    n = docs.count()
    few = kept.select(F.explode(F.array_distinct(bigrams(F.col("ts")) if pairs else F.col("ts"))).alias("term"))
    if width is not None:
        few = proposed(few, heavy_buckets(few, min_df, width, tables), width, tables)
    counts = few.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return counts.select("term", "df", (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def weighed(docs: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, *, pairs: bool = True) -> DataFrame:
    """key, term, weight: sublinear TF-IDF over a vocabulary, each document of unit length; words outside of it are dropped before anything is shuffled by document.

    The vocabulary is broadcast if it has at most WIDTH rows, else joined by a shuffle.
    """
    vocabulary = graph.saved(vocabulary.select("term", "idf"))
    side = F.broadcast(vocabulary) if vocabulary.limit(WIDTH + 1).count() <= WIDTH else vocabulary
    grams = bigrams(F.col("ts")) if pairs else F.col("ts")
    long = docs.select(F.col(key).alias("k"), F.explode(F.array(tokens)).alias("ts")).select("k", F.explode(grams).alias("term")).join(side, "term")
    raw = graph.saved(long.groupBy("k", "term").agg(((1 + F.ln(F.count("*"))) * F.any_value("idf")).alias("w")))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: a document's counts, without an exchange."""
    ends = lambda s: F.filter(F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i)))
    runs = lambda s, e: F.transform(e, lambda at, i: F.struct(F.get(s, at - 1).alias("term"), (at - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("long").alias("tf")))
    return _with(F.sort_array(terms), lambda s: _with(ends(s), lambda e: runs(s, e)))


def cluster_terms(docs: DataFrame, key: str, cluster: str, terms: Column, *, min_df: int = 2, max_df: float = 0.4, top: int = 12, digits: int = 6) -> DataFrame:
    """cluster, term, score: mean sublinear TF-IDF weight inside a cluster less half the mean weight overall, its best terms, ties to the smaller one.

    Texts are read once and stay one row a document, with counts; where its vocabulary is small (WIDTH) only
    these rows are exchanged, and sums of (cluster, term), not rows of (document, term). Keys are taken to be distinct.
    """
    rows = graph.written(docs.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.explode(F.array(counted(terms))).alias("ts")))
    sizes = graph.saved(rows.groupBy("c").agg(F.count("*").alias("n")))  # one row a cluster
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = rows.select(F.explode("ts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    vocabulary = graph.saved(counts.select("term", (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    side = F.broadcast(vocabulary) if vocabulary.count() <= WIDTH else vocabulary
    tf = 1 + F.ln("tf")
    square = F.pow(tf * F.col("idf"), 2)
    norms = rows.select("k", F.explode("ts").alias("t")).select("k", "t.term", "t.tf").join(side, "term").groupBy("k").agg(F.sqrt(F.sum(square)).alias("norm"))  # one row a document
    shares = rows.join(norms.hint("shuffle_hash"), "k").select("c", "norm", F.explode("ts").alias("t")).select("c", "t.term", "t.tf", "norm")
    sums = shares.groupBy("c", "term").agg(F.sum(tf / F.col("norm")).alias("s"))  # idf is the same in all of them
    sums = graph.saved(sums.join(vocabulary, "term").select("c", "term", (F.col("s") * F.col("idf")).alias("s")))
    overall = sums.groupBy("term").agg(F.sum("s").alias("t"))
    scored = sums.join(sizes, "c").join(overall, "term").withColumn("score", F.round(F.col("s") / F.col("n") - 0.5 * F.col("t") / F.lit(n), digits))
    return top_k(scored, "c", "term", "score", top).select(F.col("c").alias(cluster), "term", "score")
