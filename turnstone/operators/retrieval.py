"""Retrieval: BM25 postings, vector similarity, hybrid scores, ranks and their metrics.

Scores exist only for pairs that share a term; what a dense matrix would hold as zero is
accounted for in the per-query minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import graph

K1, B = 1.5, 0.75
#: Entries (term and query) that are sent to every task; more of them are exchanged.
SENT = 300_000
SEMANTIC_WEIGHT, INTENT_BONUS, FALLBACK = 0.9, 0.15, "unclear_or_media_only"


def postings(corpus: DataFrame, key: str, terms: Column, copies: Column | None = None) -> DataFrame:
    """key, term, weight: BM25 weights (the query's term counts multiply them). A posting carries its document's length.

    copies: documents that a row stands for; they count in frequencies and lengths.
    """
    docs = corpus.select(F.col(key).alias("k"), terms.alias("ts"), (F.lit(1) if copies is None else copies).alias("same")).select("k", "ts", "same", F.size("ts").alias("len"))
    long = docs.select("k", "same", "len", F.explode("ts").alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.first("same").alias("same"))
    total = docs.agg(F.sum("same").alias("N"), (F.sum(F.col("same") * F.col("len")) / F.sum("same")).alias("avg_len"))  # one row
    df = long.groupBy("term").agg(F.sum("same").alias("df"))
    rows = long.join(df, "term").crossJoin(F.broadcast(total))
    idf = F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return rows.select(F.col("k").alias(key), "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("weight"))


def bm25(queries: DataFrame, query_key: str, terms: Column, index: DataFrame, key: str) -> DataFrame:
    """query, document, bm25 of the pairs that share a term."""
    q = queries.select(query_key, F.explode(terms).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    return q.join(index, "term").groupBy(query_key, key).agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25"))


def every_score(queries: DataFrame, query_key: str, corpus: DataFrame, key: str, terms: Column, digits: int = 6) -> DataFrame:
    """query_key, key, bm25 of all pairs that share a term, summed where the document lies.

    Only words that a query has are counted and exchanged, once, to their document's partition;
    a document's contributions never leave it. Keys are taken to be distinct.
    """
    q = queries.select(query_key, F.explode(terms).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    asked = graph.saved(q.groupBy("term").agg(F.collect_list(F.struct(F.col(query_key).alias("q"), "qtf")).alias("by")))  # an entry a query with the term
    small = lambda df, rows: F.broadcast(df) if df.agg(F.coalesce(F.sum(F.size("by")) if "by" in df.columns else F.count("*"), F.lit(0))).first()[0] <= rows else df
    docs = corpus.select(F.col(key).alias("k"), F.explode(F.array(terms)).alias("ts"))  # a generator keeps the terms from being worked out twice
    held = docs.select("k", F.when(F.col("ts").isNotNull(), F.size("ts")).alias("len"), F.explode(F.concat(F.coalesce("ts", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("term"))
    held = held.join(small(asked, SENT).select("term", F.lit(True).alias("known")), "term", "left").where("known or term is null")
    counted = held.groupBy("k", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    dealt = graph.written(counted)
    n, mean = dealt.where("term is null").agg(F.count("*"), F.avg("len")).first()
    df = dealt.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
    weighed = small(graph.saved(asked.join(df, "term").select("term", idf, "by")), SENT)
    rows = dealt.where("term is not null").repartition("k").join(weighed, "term")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    parts = rows.select("k", weight.alias("w"), F.explode("by").alias("x")).select("k", "x.q", (F.col("x.qtf") * F.col("w")).alias("c"))
    return parts.groupBy("k", "q").agg(F.round(F.sum("c"), digits).alias("bm25")).select(F.col("q").alias(query_key), F.col("k").alias(key), "bm25")


def scaled(scored: DataFrame, query: str, score: str, to: str, corpus_size: int) -> DataFrame:
    """scored with min_max() as column to; only the bounds of each query are exchanged, its rows are not gathered."""
    rows = graph.written(scored)
    bounds = rows.groupBy(query).agg(F.min(score).alias("__low"), F.max(score).alias("__high"), (F.count(score) < corpus_size).alias("__missing"))
    bounds = graph.saved(bounds.select(query, F.when(F.col("__missing"), F.least("__low", F.lit(0.0))).otherwise(F.col("__low")).alias("__low"), F.when(F.col("__missing"), F.greatest("__high", F.lit(0.0))).otherwise(F.col("__high")).alias("__high")))
    bounds = F.broadcast(bounds) if bounds.count() <= SENT else bounds
    value = F.coalesce(F.try_divide(F.col(score) - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    return rows.join(bounds, query).withColumn(to, value).drop("__low", "__high")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def min_max(score: str, query: str, corpus_size: int | None = None) -> Column:
    """Scores of a query scaled to 0..1; a constant row is 0.

    corpus_size: rows may lack pairs, which score 0; then the minimum is 0 if any is missing.
    """
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    if corpus_size is not None:
        missing = F.count(score).over(w) < corpus_size
        low, high = F.when(missing, F.least(low, F.lit(0.0))).otherwise(low), F.when(missing, F.greatest(high, F.lit(0.0))).otherwise(high)
    return F.coalesce(F.try_divide(F.col(score) - low, high - low), F.lit(0.0))


def hybrid(embedding: Column, lexical: Column, weight: float | Column = SEMANTIC_WEIGHT) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return w * embedding + (1 - w) * lexical


def intent_bonus(query_intent: Column, doc_intent: Column, bonus: float = INTENT_BONUS, fallback: str = FALLBACK) -> Column:
    """Added if intents are equal, known and not the fallback."""
    known = query_intent.isNotNull() & (query_intent.cast("string") != "") & (query_intent.cast("string") != fallback)
    return F.when(known & (query_intent == doc_intent), bonus).otherwise(0.0)


def hard_filter(query_intent: Column, doc_intent: Column, penalty: float = 10.0) -> Column:
    return F.when(query_intent == doc_intent, 0.0).otherwise(-penalty)


def top_k(scored: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """rank 1..k by score, ties by key; Spark cuts each partition to k a query before the shuffle."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_relevant(ranked: DataFrame, query: str, relevant: str, rank: str = "rank") -> DataFrame:
    """query, best: the rank of its first relevant document, null if none."""
    return ranked.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("best"), F.count_if((F.col(rank) <= 5) & F.col(relevant)).alias("hits5"), F.count_if(F.col(rank) <= 5).alias("shown5"))


def first_relevant(scored: DataFrame, by: list[str], key: str, score: Column, relevant: Column, shown: int = 5) -> DataFrame:
    """by, best, hits5, shown5 like best_relevant, without ranking the documents that nobody sees.

    The rank of a query's best relevant document is one more than the number of documents
    ahead of it, so pairs are only counted; only the first few of each query are ranked.
    """
    rows = scored.select(*by, F.col(key).alias("__k"), score.alias("__s"), relevant.alias("__r"))
    ahead = lambda s, k: F.struct((-s).alias("s"), k.alias("k"))
    found = rows.groupBy(*by).agg(F.min(F.when(F.col("__r"), ahead(F.col("__s"), F.col("__k")))).alias("__best"))
    counted = rows.join(found, by).groupBy(*by).agg((1 + F.count_if(ahead(F.col("__s"), F.col("__k")) < F.col("__best"))).alias("n"), F.any_value("__best").isNotNull().alias("any"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__s"), "__k"))).where(F.col("rank") <= shown)
    seen = top.groupBy(*by).agg(F.count_if("__r").alias("hits5"), F.count("*").alias("shown5"))
    return counted.join(seen, by).select(*by, F.when(F.col("any"), F.col("n")).alias("best"), "hits5", "shown5")


def first_relevant_ranks(scored: DataFrame, by: list[str], key: str, scores: dict[str, Column], relevant: Column) -> DataFrame:
    """by and, under the name of each score, the rank of the best relevant document by it (null if none is relevant).

    All scores are compared in the same two aggregates, each a few numbers a query, however many
    scores there are: no pair is repeated for a score, and none is ranked.
    """
    names = list(scores)
    rows = scored.select(*by, F.col(key).alias("__k"), relevant.alias("__r"), *[(-s).alias(f"__s{i}") for i, s in enumerate(scores.values())])
    place = lambda i: F.struct(F.col(f"__s{i}").alias("s"), F.col("__k").alias("k"))
    found = rows.groupBy(*by).agg(*[F.min(F.when(F.col("__r"), place(i))).alias(f"__b{i}") for i in range(len(names))])
    ahead = [F.when(F.any_value(f"__b{i}").isNotNull(), 1 + F.count_if(place(i) < F.col(f"__b{i}"))).alias(name) for i, name in enumerate(names)]
    return rows.join(found, by).groupBy(*by).agg(*ahead)


def against(queries: DataFrame, docs: DataFrame, on: Column, block: int = 4096) -> DataFrame:
    """Each query with each document for which on holds, queries in blocks.

    Up to ``block`` queries are broadcast; more meet the documents block by block, a shuffle of the
    documents for each. Both ways have the same rows: the number of queries decides the plan only.
    """
    queries = graph.saved(queries)
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return docs.join(F.broadcast(queries), on)
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(blocks)).cast("int"))
    every = docs.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return every.join(dealt, (every["__block"] == dealt["__block"]) & on).drop("__block")


def metrics(best: DataFrame, *by: str) -> DataFrame:
    """n, recall@1/3/5 (share of queries with a hit), MRR and precision@5 (over documents shown)."""
    at = lambda k: F.avg((F.coalesce(F.col("best"), F.lit(1 << 30)) <= k).cast("int"))
    out = [F.count("*").alias("n"), at(1).alias("recall_at_1"), at(3).alias("recall_at_3"), at(5).alias("recall_at_5"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), F.try_divide(F.sum("hits5"), F.sum("shown5")).alias("precision_at_5")]
    return best.groupBy(*by).agg(*out) if by else best.agg(*out)


def noisy_intent(intent: Column, key: Column, kinds: int, rate: float | Column, seed: int = 42) -> Column:
    """An integer intent 0..kinds-1 replaced by another one for a hashed share of keys."""
    u = V.hash_fraction(V.seeded(seed, key))
    shift = F.lit(1) + F.floor(V.hash_fraction(V.seeded(seed + 1, key)) * (kinds - 1)).cast("int")
    return F.when(u < rate, F.pmod(intent + shift, F.lit(kinds))).otherwise(intent)


def random_score(query: Column, key: Column, seed: int = 42) -> Column:
    return V.hash_fraction(F.concat(F.lit(f"{seed}:"), query.cast("string"), F.lit(":"), key.cast("string")))


def random_first_relevant(queries: DataFrame, docs: DataFrame, shown: int = 5, seed: int = 42) -> DataFrame:
    """query, best, hits5, shown5 like first_relevant for random_score() of queries (query, qi) against docs (doc, di), but for a query's own key.

    Pairs are hashed as they are met and never kept: relevant ones and a slice of the others give each query
    limits, and a second pass counts what lies above them. Only documents that reach the first few are rows.
    """
    q = graph.saved(queries.select("query", "qi", F.concat(F.lit(f"{seed}:"), F.col("query").cast("string"), F.lit(":")).alias("head")))
    d = docs.select("doc", "di", F.col("doc").cast("string").alias("tail"), F.pmod(F.xxhash64("doc"), F.lit(1024)).alias("place"))
    asked, every = q.count(), docs.count()
    tasks = max(1, min(-(-asked * every // 5_000_000), 4_000))  # a narrow row is much work, however few bytes
    d = graph.saved(d.repartition(tasks))
    digest, other, relevant = F.sha2(F.concat("head", "tail"), 256), F.col("query") != F.col("doc"), F.coalesce(F.col("qi") == F.col("di"), F.lit(False))
    score = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")  # random_score() in whole numbers
    pairs = lambda side, on: d.join(F.broadcast(side), on) if asked <= SENT else against(side, d, on)
    some = pairs(q, other & (relevant | (F.col("place") < 16))).select("query", (F.col("place") % 16).alias("place"), relevant.alias("r"), score.alias("s"))
    most = some.groupBy("query", "place").agg(F.max(F.when(F.col("r"), F.col("s"))).alias("r"), F.max("s").alias("s"))
    # first: the best relevant score; low: at least `shown` documents reach it
    limits = most.groupBy("query").agg(F.max("r").alias("first"), F.get(F.sort_array(F.collect_list("s"), asc=False), F.lit(shown - 1)).alias("low"))  # 16 entries
    limits = graph.saved(limits.withColumn("low", F.coalesce("low", F.lit(0))))
    hexed = F.lower(F.lpad(F.hex(F.least("first", "low")), 12, "0"))  # digests are compared with it as text
    q = q.join(limits, "query", "left").select("query", "qi", "head", "first", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce(hexed, F.lit("")).alias("hexed"))
    above = pairs(q, other & (digest >= F.col("hexed"))).select("query", "doc", "first", "low", relevant.alias("r"), score.alias("s"))
    counted = above.groupBy("query", F.when((F.col("s") >= F.col("low")) | (F.col("s") == F.col("first")), F.col("doc")).alias("doc"), "first", "low").agg(F.max("s").alias("s"), F.count("*").alias("n"), F.count_if("r").alias("r"))
    counted = graph.saved(counted)
    level = F.col("s") == F.col("first")
    ties = counted.where(level).groupBy("query").agg(F.min(F.when(F.col("r") > 0, F.col("doc"))).alias("d"))
    ahead = counted.join(ties, "query").groupBy("query").agg((1 + F.sum(F.when((F.col("s") > F.col("first")) | (level & (F.col("doc") < F.col("d"))), F.col("n")).otherwise(0))).alias("best"))
    each = counted.where("doc is not null and s >= low").select("query", "doc", "s", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: i <= F.col("r"))).alias("r"))  # equal keys are rows of their own
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "doc"))).where(F.col("rank") <= shown)
    return top.groupBy("query").agg(F.count_if("r").alias("hits5"), F.count("*").alias("shown5")).join(ahead, "query", "left").select("query", "best", "hits5", "shown5")


def nearest_two(scored: DataFrame, item: str, centre: str, distance: str) -> DataFrame:
    """item, nearest, second, distance, margin."""
    s = F.array_sort(F.collect_list(F.struct(F.col(distance).alias("d"), F.col(centre).alias("c"))))  # one entry a centre
    one = scored.groupBy(item).agg(s.alias("s"))
    return one.select(item, F.get("s", F.lit(0))["c"].alias("nearest"), F.get("s", F.lit(1))["c"].alias("second"), F.get("s", F.lit(0))["d"].alias("distance"), (F.get("s", F.lit(1))["d"] - F.get("s", F.lit(0))["d"]).alias("margin"))


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, *, query_key: str = "query_id", key: str = "case_id") -> DataFrame:
    """BM25 top k of free-text queries (text) over corpus (text); low_information marks queries of fewer than 2 terms.

    Queries without terms have no results.
    """
    if corpus.isEmpty():
        raise ValueError("the corpus is empty")
    terms = X.tokens(F.col("text"))
    found = top_k(bm25(queries, query_key, terms, postings(corpus, key, terms), key), query_key, key, "bm25", k)
    return found.join(queries.select(query_key, (F.size(terms) < 2).alias("low_information")), query_key)


def cluster_terms(weights: DataFrame, assigned: DataFrame, item: str, cluster: str, top: int = 12, digits: int = 9) -> DataFrame:
    """cluster, term, score, place: mean weight inside less half the mean weight overall."""
    n = assigned.groupBy(cluster).agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("all_n"))
    inside = weights.join(assigned, item).groupBy(cluster, "term").agg(F.sum("weight").alias("s")).join(n, cluster)
    overall = weights.join(assigned.select(item), item, "left_semi").groupBy("term").agg(F.sum("weight").alias("t")).crossJoin(F.broadcast(total))  # total: one row
    scored = inside.join(overall, "term").withColumn("score", F.round(F.col("s") / F.col("n") - 0.5 * F.col("t") / F.col("all_n"), digits))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))).where(F.col("place") <= top).select(cluster, "term", "score", "place")


def tf_idf(docs: DataFrame, key: str, terms: Column, min_df: int = 2, max_df: float = 0.4) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document of unit length."""
    base = docs.select(F.col(key).alias("k"), terms.alias("ts"))
    n = base.agg(F.count("*").alias("N"))
    tf = base.select("k", F.explode("ts").alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("N")))
    raw = tf.join(df, "term").withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def bigrams(tokens: Column) -> Column:
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))
