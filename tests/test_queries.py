"""Every registered query against its DuckDB twin at sf0.001, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from turnstone.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(rows):
    return sorted((tuple("~" if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [str(x) for x in r])


KINDS = {"refund", "compensation", "account_action", "redirected_to_dm", "redirected_to_other_operator", "escalated", "troubleshooting", "self_service", "feedback_acknowledged", "information_provided", "clarification_requested", "other", "unresolved"}
#: What must hold of the rows of queries that SQL cannot express; tests/test_core.py and tests/test_whole.py compare the operators with plain versions.
PROPERTIES = {
    "t17_evidence": lambda rows: rows and all(v is not None for r in rows for k, v in r.items() if k == "conv_id"),
    "t31_memory_records": lambda rows: len({r["case_id"] for r in rows}) == len(rows) > 0
    and all(r["resolution_type"] in KINDS and len(r["customer_problem"]) <= 500 and (r["in_primary_corpus"] == (r["evidence_quality"] == "strong")) and (r["n_brand_turns"] > 0 or r["historical_response"] == "") for r in rows)
    and all(set(r["response_tweet_ids"].split(",")) <= set(r["source_tweet_ids"].split(",")) for r in rows if r["response_tweet_ids"]),
    "p9_evidence_quality": lambda rows: rows and {r["evidence_quality"] for r in rows} <= {"strong", "weak", "no_brand_reply", "none", "no_reply"} and all((r["evidence_quality"] == "strong") == (r["exclusion_reason"] in (None, "")) for r in rows),
    "u7_diverse_sample": lambda rows: len({r["doc_id"] for r in rows}) == len(rows) == 60 and len({r["lang"] for r in rows}) == 4,
    "m4_kmeans": lambda rows: [r["k"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(8, 16)) and sum(r["chosen"] for r in rows) == 1 and all(-1 <= r["silhouette"] <= 1 and r["inertia"] > 0 and 0 < r["min_share"] <= 1 / r["k"] + 1e-9 for r in rows),
    "m7_tfidf_classifier": lambda rows: rows and sum(r["lang"] == r["predicted"] for r in rows) / len(rows) > 0.9,  # held-out accuracy
    "s17_hashed_vectors": lambda rows: _unit_vectors(rows, 64),
    "m3_lsa": lambda rows: _unit_vectors(rows, 8),
    "m16_handled_messages": lambda rows: len({r["case_id"] for r in rows}) == len(rows) > 0 and all((r["action"] == "ESCALATE" and r["reply"] is None and r["reasons"]) or (r["action"] == "AUTO_HANDLE" and r["reply"]) for r in rows),
}


def _unit_vectors(rows, size):
    norms: dict = {}
    for r in rows:
        norms.setdefault(r["item_id"], []).append(r["x"])
    return norms and all(len(x) == size and (abs(sum(y * y for y in x) - 1) < 1e-9 or not any(x)) for x in norms.values())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in registry.ORACLES:
        assert name in PROPERTIES, f"{name} has neither SQL nor a stated property"
        assert PROPERTIES[name]([dict(zip(columns, r)) for r in rows])
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert normal(rows) == normal(duck.sql(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["t16_turn_signals", "t2_t5_normalised", "j12_threads", "m8_bm25_top"])
def test_plans_run_no_python(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
