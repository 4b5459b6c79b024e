"""Queries that must do the whole job: no rows, rounds or documents left out."""

import inspect

from turnstone.operators import scores as SC
from turnstone.plans import registry


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_lineitem_groups_take_all_rows(spark, tmp_path):
    rows = [(1, 1), (1, 2), (51, 2), (52, 3), (53, 3), (53, 3), (7, 60), (8, 61), (8, 60), (99, 49), (120, 70)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["j12_bipartite_groups"](spark, str(tmp_path)).collect()
    want = union_find((o, -s - 1) for o, s in rows)
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert len(set(want.values())) == 5 and any((a % 50) != (b % 50) for a, b in rows)


def test_lineitem_groups_of_the_driver_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()
    got = registry.QUERIES["j12_bipartite_groups"](spark, folder).collect()
    assert {r.node: r.root for r in got} == union_find((o, -s - 1) for o, s in rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lengths(tmp_path, spark):
    """Short and long documents; the words of long ones are in no short one."""
    said = {"en": "train station late refund", "fr": "gare billet retard merci"}
    rows = []
    for i in range(24):
        lang = "en" if i % 2 else "fr"
        text = " ".join(f"{said[lang]} {lang}word{i % 5}" for _ in range(2)) if i < 12 else " ".join(f"long{lang} {said[lang]} x{k % 30}" for k in range(200))
        rows.append((i, text, lang, "s", len(text)))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r[4] >= 2000 for r in rows) == 12
    return rows


def test_classifier_predicts_long_documents(spark, tmp_path):
    rows = lengths(tmp_path, spark)
    got = registry.QUERIES["m7_tfidf_classifier"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(r[0], r[2]) for r in rows if r[0] % 4 == 0]
    assert all(r.predicted in ("en", "fr") for r in got)


def test_cluster_terms_of_long_documents(spark, tmp_path):
    lengths(tmp_path, spark)
    got = {(r.lang, r.term) for r in registry.QUERIES["m2_cluster_terms"](spark, str(tmp_path)).collect()}
    assert {("en", "longen"), ("fr", "longfr")} <= got


def test_kmeans_sweeps_all_k(spark):
    got = registry.QUERIES["m4_kmeans"](spark, "/root/testdata/sf0.001").collect()
    assert [r.k for r in got] == list(range(8, 16)) and sum(r.chosen for r in got) == 1


def test_bootstrap_runs_all_rounds(spark, monkeypatch):
    real, rounds = SC.bootstrap_interval, []

    def watched(*args, **named):
        call = inspect.signature(real).bind(*args, **named)
        call.apply_defaults()
        rounds.append(call.arguments["rounds"])
        return real(*args, **named)

    monkeypatch.setattr(SC, "bootstrap_interval", watched)
    got = registry.QUERIES["a21_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert rounds == [1000] and got[0].low <= got[0].mean <= got[0].high
