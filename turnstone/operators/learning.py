"""The choice among k-means sweeps, and LSA. Models themselves are fitted in models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators import graph


def chosen_k(rows: list[dict], min_ari: float = 0.6, min_share: float = 0.02) -> int:
    """The k of the best silhouette among stable sweeps without tiny clusters, else of all."""
    fit = [r for r in rows if r["seed_ari"] >= min_ari and r["min_share"] >= min_share] or rows
    return max(fit, key=lambda r: (r["silhouette"], -r["k"]))["k"]


def vocabulary_size(docs: DataFrame, terms: str, least: int = 2) -> int:
    """How many terms are in `least` documents or more."""
    return max(1, docs.select(F.explode(F.array_distinct(terms)).alias("t")).groupBy("t").count().where(F.col("count") >= least).count())


def lsa(df: DataFrame, k: int, source: str = "weights", to: str = "features") -> DataFrame:
    """Term weights reduced to the k strongest singular directions (not centred), of unit length.

    The decomposition needs the terms' products only, terms x terms numbers at most whatever the
    number of rows; rows are then multiplied by the terms x k matrix side by side. Bound: the Gram
    matrix is terms x terms on the driver, so this is for vocabularies of up to some 20,000 terms
    (Spark refuses more than 65,535 columns).
    """
    rows = df.select(source).rdd.map(lambda r: OldVectors.fromML(r[0]))
    right = np.asarray(RowMatrix(rows).computeSVD(k).V.toArray())
    directions = [[float(x) for x in row] for row in right * np.where(right.sum(axis=0) < 0, -1.0, 1.0)]  # terms x k
    table = df.sparkSession.createDataFrame(list(enumerate(directions)), "term int, w array<double>")
    entry = F.explode(F.filter(F.transform(vector_to_array(F.col(source)), lambda x, i: F.struct(i.alias("term"), x.alias("x"))), lambda e: e["x"] != 0)).alias("e")
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    keyed = graph.saved(keyed)
    long = keyed.select("__row", entry).select("__row", "e.term", "e.x").join(table, "term").select("__row", "x", F.posexplode("w").alias("i", "w")).groupBy("__row", "i").agg(F.sum(F.col("x") * F.col("w")).alias("y"))
    reduced = long.groupBy("__row").agg(array_to_vector(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"])).alias("__r"))  # k entries a row
    zero = array_to_vector(F.array_repeat(F.lit(0.0), k))  # rows without terms have no direction
    placed = keyed.join(reduced, "__row", "left").withColumn("__r", F.coalesce("__r", zero))
    return Normalizer(inputCol="__r", outputCol=to).transform(placed).drop("__r", "__row")
