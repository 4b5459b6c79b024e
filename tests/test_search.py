"""The pruned search index against plain scoring, its saved tables, and kept answers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.operators import retrieval as RT
from turnstone.operators import search as SE

def words():
    return F.split("text", " ")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(700)] + [(900 + i, "same text here") for i in range(30)] + [(None, "w1"), (990, None)]
    queries = [(i, " ".join(word() for _ in range(int(rng.integers(1, 12))))) for i in range(25)] + [(50, "same here here"), (51, "unknown"), (52, ""), (53, "w1 w1 w2 w3")]
    return docs, queries


@pytest.fixture(scope="module")
def frames(spark, data):
    return spark.createDataFrame(data[0], "doc bigint, text string").repartition(3), spark.createDataFrame(data[1], "q bigint, text string")


def plain(docs, queries, k):
    docs = [(i, t.split(" ") if t is not None else []) for i, t in docs if i is not None]
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    out = []
    for q, text in queries:
        want = Counter(text.split(" "))
        found = []
        for i, t in docs:
            tf = Counter(t)
            shared = [w for w in want if tf[w]]
            if shared:
                found.append((-round(sum(want[w] * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in shared), 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return sorted((r[0], r[1], round(r[2], 5), r[3]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_pruned_search_equals_plain_scoring(frames, data, k):
    docs, queries = frames
    got = rows(SE.search(SE.indexed(docs, "doc", words()), queries, "q", "doc", words(), k))
    assert got == sorted((q, i, round(s, 5), r) for q, i, s, r in plain(*data, k))


def test_an_index_for_one_set_of_queries_gives_the_same(frames):
    docs, queries = frames
    few = SE.indexed(docs, "doc", words(), only=queries.select(F.explode(words()).alias("term")))
    assert rows(SE.search(few, queries, "q", "doc", words(), 5)) == rows(SE.search(SE.indexed(docs, "doc", words()), queries, "q", "doc", words(), 5))


def test_few_pairs_are_verified(spark):
    folder = "/root/testdata/sf0.01"
    docs, items, terms = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), X.tokens(F.col("text"))
    index = SE.indexed(docs, "doc_id", terms)
    asked = SE._asked(index, items, "item_id", terms)
    near, _ = SE.contenders(index, asked, 10)
    assert near.count() * 10 < RT.bm25(items, "item_id", terms, RT.postings(docs, "doc_id", terms), "doc_id").count()  # of all pairs that share a term
    assert index.blocks.agg(F.max(F.size("postings"))).first()[0] <= 2 * SE.BLOCK


def above(plan: str, at: int) -> list[str]:
    """The lines of a plan from a node's parent up to the root."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line)
    return out


def test_a_saved_index_is_searched_without_moving_it(spark, frames, monkeypatch):
    monkeypatch.setattr(SE, "SMALL", 0)
    monkeypatch.setattr(SE, "PAIRS", 0)
    docs, queries = frames
    SE.indexed(docs, "doc", words()).save("kept_index", 4)
    index = SE.loaded(spark, "kept_index")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = SE._asked(index, queries, "q", words())
        for step in (SE._met(asked, index, F.col("b.top") > 0), SE._looked_up(asked.select("q", "term", "qtf", F.col("q").alias("k")), index)):
            plan = step._jdf.queryExecution().executedPlan().toString()
            scans = [i for i, line in enumerate(plan.split("\n")) if "FileScan" in line]
            assert scans and "Bucketed: true" in plan
            for i in scans:
                nodes = above(plan, i)
                if any("Subquery" in line for line in nodes):  # a filter for the queries
                    continue
                join = next(n for n, line in enumerate(nodes) if "Join" in line)
                assert not any("Exchange" in line for line in nodes[:join]), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows(SE.search(index, queries, "q", "doc", words(), 5)) == rows(SE.search(SE.indexed(docs, "doc", words()), queries, "q", "doc", words(), 5))


def test_answers_are_kept_by_text(spark, frames):
    docs, queries = frames
    index = SE.indexed(docs, "doc", words())
    asked = []

    def find(new):
        asked.append(sorted(r.text for r in new.collect()))
        return SE.search(index, new, "text_id", "doc", words(), 3)

    kept = SE.Answers(spark, "kept_answers")
    first = rows(kept.ask(queries, "q", "doc", find))
    assert first == rows(SE.search(index, queries, "q", "doc", words(), 3))
    again = spark.createDataFrame([(1, "same here here"), (2, "unknown"), (3, "brand new w5"), (4, "w5 brand new"), (5, "brand new w5")], "q bigint, text string")
    got = rows(kept.ask(again, "q", "doc", find))
    assert asked[1] == ["brand new w5", "w5 brand new"] and {r[0] for r in got} == {1, 3, 4, 5}
    assert [r[1:] for r in got if r[0] == 3] == [r[1:] for r in got if r[0] == 5]


def test_unit_vectors_are_saved(spark):
    SE.save_vectors(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id bigint, v array<float>"), "id", "v", "kept_index", 2)
    got = spark.table("kept_index_vectors").collect()
    assert [(r.k, [round(x, 6) for x in r.v]) for r in got] == [(1, [0.6, 0.8])]
    with pytest.raises(ValueError):
        SE.search(None, None, "q", "k", words(), 0)
