"""Faults that show only on larger tables or odd rows, made small."""

import datetime as dt

import duckdb
import pytest

from turnstone.plans import registry


def same_as_sql(spark, name, folder, *tables):
    """The rows of a query are those of its SQL over the tables in folder."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    normal = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    want = normal(con.sql(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall())
    assert normal(tuple(r) for r in got.collect()) == want
    return want


def test_orphan_links_round_to_seconds_and_follow_large_ids(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        (1, at(0.6), 1, "view"), (2, at(7201.4), 1, "purchase"),  # 7200 rounded seconds apart
        (3, at(0.4), 2, "view"), (4, at(7200.6), 2, "purchase"),  # 7201 apart
        (9_000_000, at(100), 3, "click"), (11, at(105), 3, "view"), (12, at(200), 3, "error"),  # ids over a million outweigh seconds
        (9_000_001, at(0), 4, "click"), (14, at(7300), 4, "view"), (15, at(7400), 4, "error"),  # out of reach, whatever its id
        (16, at(50.5), 5, "view"), (17, at(50.4), 5, "error"), (18, at(51.5), 5, "error"),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = dict(same_as_sql(spark, "j9_orphan_links", tmp_path, "events"))
    assert want[2] == 1 and 4 not in want and want[12] == 9_000_000 and want[15] == 14


def test_scaled_scores_of_every_item(spark, tmp_path):
    docs = [(1, "late train refund"), (2, "train ticket"), (3, "late late bus"), (4, "the"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "late train"), (7, "ticket refund train train"), (13, "bus"), (14, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = same_as_sql(spark, "w13_scaled_scores", tmp_path, "documents", "benchmark")
    assert {r[0] for r in want} == {0, 7, 13}


def test_terms_of_marked_and_plain_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from turnstone.functions import text as X

    asked, real = [], F.contains
    monkeypatch.setattr(F, "contains", lambda x, mark: asked.append(str(mark)) or real(x, mark))
    want = {"Bob’s ties, replies": ["bob", "tie", "reply"], "bus gas maps pass s": ["bus", "gas", "map", "pass", "s"], "see https://a.b/c @you #Tags x": ["see", "tag", "x"], "don&rsquo;t &commat;bob": ["dont"], "": []}
    found = spark.createDataFrame([(t,) for t in want] + [(None,)], "text string").select("text", X.tokens(F.col("text")).alias("terms"))
    assert {r.text: r.terms for r in found.collect()} == {**want, None: []}
    assert any("@" in mark for mark in asked)  # texts without marks pass the regexes by


def test_evidence_is_searched_by_text(spark, monkeypatch):
    from turnstone.operators import agent, retrieval

    scored, real = [], retrieval.bm25

    def watched(*args):
        out = real(*args)
        scored.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "bm25", watched)
    texts = ["late train refund", "lost ticket please", "late bus"]
    memory = spark.createDataFrame([(f"c{i:03}", texts[i % 2], "x", "y", "z", "none") for i in range(120)], "case_id string, customer_problem string, intent string, historical_response string, resolution_type string, escalation_signal string")
    messages = spark.createDataFrame([(f"m{i}", texts[i % 3]) for i in range(30)] + [("none", None)], "case_id string, message string")
    got = agent.evidence_for(messages, memory).groupBy("case_id").count().collect()
    assert scored == [3]  # pairs of different texts with a common term
    assert sorted(r["case_id"] for r in got) == sorted(f"m{i}" for i in range(30)) and all(r["count"] == 5 for r in got)


def test_vector_searches_form_no_pairs(spark, monkeypatch):
    from turnstone.operators import retrieval

    def pairs(*args):
        raise AssertionError("pairs became rows")

    monkeypatch.setattr(retrieval, "against", pairs)
    sizes = {"f7_cosine_top": 25, "f8_j17_hybrid": 25, "m19_strategy_metrics": 5, "m11_weight_grid": 11}
    assert {n: registry.QUERIES[n](spark, "/root/testdata/sf0.001").count() for n in sizes} == sizes


def test_random_baseline_keeps_no_pairs(spark, tmp_path, monkeypatch):
    from turnstone.operators import retrieval

    def pairs(*args):
        raise AssertionError("pairs became rows")

    monkeypatch.setattr(retrieval, "against", pairs)
    label = lambda i: None if i in (3, 200) else 77 if i == 300 else 5 if i in (400, 7) else i % 4
    rows = [(i, label(i), [1.0, i % 7 + 1.0]) for i in range(620)]  # a label of one vector, of two, and none
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert same_as_sql(spark, "u16_random_baseline", tmp_path, "embeddings")[0][0] == 7


def test_no_task_gathers_a_component(spark, monkeypatch):
    from pyspark.sql import functions as F

    from turnstone.operators import graph

    monkeypatch.setattr(graph, "HUB", 1_000, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        jvm = spark.sparkContext._jsc.sc()
        first, n = jvm.dagScheduler().nextStageId(), 60_000
        edges = spark.range(n).select(F.col("id").alias("a"), (-F.col("id") % 300 - 1).alias("b")).union(spark.range(300).select(F.lit(n).alias("a"), (-F.col("id") - 1).alias("b")))
        assert graph.components(edges).where(F.col("root") == -300).count() == n + 301  # all hang together
        read = []
        for stage in range(first, jvm.dagScheduler().nextStageId()):
            tasks = jvm.statusStore().taskList(stage, 0, 1_000)
            for i in range(tasks.size()):
                if tasks.apply(i).taskMetrics().isDefined():
                    read.append(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead())
        assert 0 < max(read) < n // 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["r16_unsafe_cases", "u2_leakage_checks", "r8_weak_labels", "u14_final_splits"])
def test_splits_read_texts_once(spark, tmp_path, monkeypatch, name):
    from turnstone.operators import graph

    plans, real = [], graph.saved
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    monkeypatch.setattr(graph, "saved", lambda df: real(seen(df)))
    texts = ["Hello @you 12", "hello @me  7!", "", "...", "other words", "a text of its own"]
    docs = [(i, texts[(i * 5 + i // 7) % 6], ("en", "fr", " ")[i % 3], i * 37 % 900) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path))
    seen(rows)
    assert sum(p.count("(?U)@") for p in plans) == 1
    if name != "r16_unsafe_cases":  # which also names empty messages
        same_as_sql(spark, name, tmp_path, "documents")


def test_opener_keys_by_ranges(spark):
    from pyspark.sql import functions as F

    from turnstone.functions import text as X

    points = [i for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000] + [0xFFFF, 0x1F600, 0x10FFFF]
    text = F.col("text")
    x = spark.createDataFrame([(f"a{chr(i)}b",) for i in points], "text string")
    assert x.where(F.regexp_replace(text, X.OTHER, " ") != F.regexp_replace(text, "[^a-z0-9 ]+", " ")).count() == 0
    assert x.where(~F.rlike(text, F.lit(X.OTHER))).count() == 26 + 10 + 1


@pytest.fixture
def plans(monkeypatch):
    """Optimised plans of all that is saved or written meanwhile."""
    from turnstone.operators import graph

    out = []
    for name in ("saved", "written"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, real=real: out.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    return out


def test_cluster_terms_read_texts_once(spark, tmp_path, plans):
    words = ["train", "late", "refund", "bus", "ticket", "café", "x1"]
    docs = [(i, None if i == 5 else " ".join(words[(i * k + k) % 7] for k in range(i % 9)), (None, "en", "fr")[i % 3]) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert same_as_sql(spark, "m2_cluster_terms", f"{tmp_path}/a", "documents")
    plans.append(registry.QUERIES["m2_cluster_terms"](spark, f"{tmp_path}/a")._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("(?U)@") for p in plans) == 2  # once in each of the two runs
    spark.createDataFrame([*docs, docs[8], (7, "late late tram", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert same_as_sql(spark, "m2_cluster_terms", f"{tmp_path}/b", "documents")  # keys that repeat


def test_gram_vocabulary_reads_texts_once(spark, tmp_path, plans):
    words = ["train", "late", "refund", "bus", "ticket"]
    docs = [(i, None if i == 5 else " ".join(words[(i * k + k) % 5] for k in range(i % 9))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert any(" " in r[0] for r in same_as_sql(spark, "m1_gram_vocabulary", tmp_path, "documents"))
    assert not plans  # neither texts nor partial counts are laid down


def test_one_search_builds_no_index(spark, tmp_path, monkeypatch):
    from turnstone.operators import search

    monkeypatch.setattr(search, "indexed", None)
    docs = [(i, None if i % 11 == 5 else " ".join(("late train", "bus", "refund please", "train")[(i * k + k) % 4] for k in range(i % 9))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "late train"), (7, "refund refund bus"), (13, None), (14, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = same_as_sql(spark, "m8_bm25_top", tmp_path, "documents", "benchmark")  # texts that are null have no length
    assert len(want) == 20


def test_brand_cases_search_no_signals_that_are_not_read(spark, plans):
    rows = registry.QUERIES["s19_brand_cases"](spark, "/root/testdata/sf0.001")
    plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
    assert not any(r"\d+/\d+" in p for p in plans)  # as display_text() has it
    assert rows.count()
