"""Brands, profiles, registries, label tables, agent runs and caches."""

import datetime as dt
import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.operators import brand as BR
from turnstone.operators import episodes as E
from turnstone.operators import frames as FR
from turnstone.operators import hooks as H
from turnstone.operators import labels as L
from turnstone.operators import registry as RG
from turnstone.operators import scores as SC
from turnstone.streaming import messages as ST

T0 = dt.datetime(2024, 1, 1, 9)
MESSAGES = "tweet_id long, author_id string, inbound boolean, created_at timestamp, text string, response_tweet_ids array<long>, in_response_to_tweet_id long, source_row long"


def said(i, who, inbound, minutes, text, parent=None):
    return (i, who, inbound, T0 + dt.timedelta(minutes=minutes), text, [], parent, i)


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        said(1, "100", True, 0, "my wifi is broken"), said(2, "acme", False, 5, "@100 have you tried restarting? ^KC", 1), said(3, "100", True, 10, "yes thanks, all sorted", 2),
        said(4, "100", True, 3000, "it broke again today", 3), said(5, "rail", False, 3010, "@100 ask @acme please", 4),
        said(6, "200", True, 20, "hello @acme where is my seat"), said(7, "acme", False, 60, "@200 which train are you on?"),  # an orphan
        said(8, "300", True, 0, "not about them"), said(9, "other", False, 1, "hi", 8),
    ]
    return BR.built(spark.createDataFrame(rows, MESSAGES), "acme")


def test_brand_cases(built):
    got = {r.case_id: r for r in built.cases.collect()}
    assert sorted(got) == ["case_1", "case_4", "case_6"]
    assert (got["case_4"].continues_case_id, got["case_4"].customer_id, got["case_1"].turn_count) == ("case_1", "100", 3)
    assert got["case_6"].source_tweet_ids == [6, 7] and got["case_6"].has_brand_reply
    threads = {r.conversation_id: r for r in built.conversations.collect()}
    assert sorted(threads) == ["conv_1", "conv_6"]
    one = threads["conv_1"]
    assert (one.customer_ids, one.other_agent_ids, one.case_ids, one.tweet_count) == (["100"], ["rail"], ["case_1", "case_4"], 5)
    assert one.max_gap_hours == pytest.approx(2990 / 60) and [t.tweet_id for t in one.turns] == [1, 2, 3, 4, 5]


def test_brand_outputs(spark, built, tmp_path):
    paths = BR.write_outputs(built, str(tmp_path), "acme")
    assert {k: spark.read.parquet(p).count() for k, p in paths.items()} == {"conversations": 2, "tweets": 7, "cases": 3}
    assert BR.write_support_cases(built.cases, f"{tmp_path}/some", ["acme"]) == {"acme": 3}
    assert BR.write_support_cases(built.cases, f"{tmp_path}/lines", jsonl=True) == {"acme": 3}


def test_brand_needs_rows():
    with pytest.raises(ValueError):
        BR.built(None, "acme")


@pytest.mark.parametrize("n", [0, 1, 5, 12_000])
def test_context_of_long_chains(spark, n):
    """n unowned messages above a customer's first one, oldest first, without a cap."""
    rows = spark.range(n + 1).select(
        F.col("id").alias("tweet_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_tweet_id"), F.lit("c").alias("conversation_id"), F.when(F.col("id") == n, "case_x").alias("case_id"),
        F.when(F.col("id") == n, "me").alias("owner_id"), F.when(F.col("id") == n, "customer").otherwise("brand_agent").alias("role"), F.lit(T0).alias("created_at"), F.col("id").alias("reply_depth"),
    )
    got = E.context_ids(rows).collect()
    assert [(r.case_id, r.context_tweet_ids) for r in got] == [("case_x", list(range(n)))]


def test_context_stops_on_cycles_and_other_threads(spark):
    rows = [(1, 3, "c", None, None), (2, 1, "c", None, None), (3, 2, "c", None, None), (4, 3, "c", "case_4", "me"), (5, 9, "c", "case_5", "me"), (9, None, "d", None, None), (6, 4, "c", "case_6", "me")]
    frame = spark.createDataFrame([(*r, "customer" if r[4] else "brand_agent", T0, 0) for r in rows], "tweet_id long, parent_tweet_id long, conversation_id string, case_id string, owner_id string, role string, created_at timestamp, reply_depth long")
    got = {r.case_id: r.context_tweet_ids for r in E.context_ids(frame).collect()}
    assert got == {"case_4": [1, 2, 3], "case_5": [], "case_6": []}


def test_percent_ranks_run_in_ranges(spark):
    rows = [(i, (i * 7919) % 997 / 10, None if i % 50 == 0 else float(i % 3)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r for r in SC.percent_rank_avg(frame, ["a", "b"]).collect()}
    for c, k in (("a", 1), ("b", 2)):
        values = sorted(r[k] for r in rows if r[k] is not None)
        for r in rows[::37]:
            if r[k] is None:
                assert got[r[0]][f"pct_{c}"] is None
            else:
                below, same = sum(v < r[k] for v in values), values.count(r[k])
                assert got[r[0]][f"pct_{c}"] == pytest.approx((below + 1 + (same - 1) / 2) / len(values))
    assert SC.percent_rank_avg(frame.where("id < 0"), ["a"]).collect() == []


# ---- entities ----

ENTITY = st.sampled_from(["&amp;", "&lt", "&copy;", "&copy", "&notit;", "&notin;", "&#65;", "&#x41;", "&#X1F600", "&#0;", "&#128;", "&#129;", "&#55296;", "&#1114112;", "&#11;", "&#xFFFE;", "&bogus;", "&", "&;", "&#;", "&#x;", "&NotEqualTilde;", "&Aacute", "&AMP", "a", " ", ";", "x1", "\n", "é"])


def test_unescape_equals_the_standard_library(spark):
    cases: list[str] = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(ENTITY, max_size=6))
    def collect(parts):
        cases.append("".join(parts))

    collect()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", X.unescaped(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: html.unescape(x) for i, x in enumerate(cases)}


# ---- registry ----


def registry(n=8):
    intent = lambda name: {f: [name] for f in RG.FIELDS} | {"name": name, "positive_examples": [{"case_id": "c1"}], "negative_examples": ["text"], "known_confusable_intents": [{"intent": "any"}]}
    return {"intents": [intent(f"intent_{i}") for i in range(n)], "fallback": intent("unclear"), "status": RG.CANDIDATE, "warning": "x"}


def test_registry_checks(spark):
    assigned = spark.createDataFrame([("c1", "train"), ("c2", "golden")], "case_id string, split string")
    none = spark.createDataFrame([], "case_id string")
    assert RG.registry_errors(registry(), assigned, none) == []
    bad = registry(3)
    bad["intents"][0] |= {"name": "Not Snake", "definition": "", "positive_examples": [{"case_id": "c2"}], "known_confusable_intents": [{"intent": "gone"}]}
    bad["intents"][1]["name"] = "intent_2"
    errors = RG.registry_errors(bad, assigned, spark.createDataFrame([("c2",)], "case_id string"))
    for part in ("3 intents", "intent_2: name is used more than once", "'Not Snake': name is not snake case", "definition is missing", "unknown intent gone", "c2 is not a train case", "c2 is a golden or calibration case"):
        assert any(part in e for e in errors), part


def test_registry_freezes(spark):
    final = RG.finalized(registry(), "A. Reviewer", "2024-02-03", {"n": 50})
    assert "warning" not in final["taxonomy"] and final["taxonomy"]["status"] == "HUMAN_CALIBRATED"
    document = RG.frozen(final, {"calibration_set_size": 50, "golden_case_ids_sha256": "x", "date_created": "2024-02-04"})
    assert RG.frozen_errors(document) == [] and document["labels"][-1] == "unclear"
    document["taxonomy"]["intents"][0]["definition"] = "edited"
    assert RG.frozen_errors(document) == ["content_sha256 does not match: the document was edited"]
    with pytest.raises(ValueError):
        RG.finalized(registry(), " ", "2024-02-03", {})
    with pytest.raises(ValueError):
        RG.finalized(registry(), "A", "soon", {})


# ---- label tables ----

TURNS = [(7, "1", "customer", T0, "hello"), (8, "acme", "brand_agent", T0, "hi")]
TURN = "array<struct<tweet_id: long, author_id: string, role: string, created_at: timestamp, text: string>>"


def test_labelling_pack_and_its_fingerprint(spark):
    golden = spark.createDataFrame([(f"c{i}", f"opening {i}", TURNS, T0, [7, 8], "v") for i in range(5)], f"case_id string, opening_message string, turns {TURN}, first_timestamp timestamp, source_tweet_ids array<long>, conversation_id string")
    pack = FR.labelling_pack(golden)
    rows = pack.orderBy("labeling_order").collect()
    assert [r.labeling_order for r in rows] == [1, 2, 3, 4, 5] and all(r[c] == "" for r in rows for c in FR.GOLD_COLUMNS)
    assert rows[0].conversation == "[CUSTOMER 7] hello\n[BRAND_AGENT 8] hi" and rows[0].source_tweet_ids == "[7,8]"
    mark = FR.pack_fingerprint(pack)
    assert mark == FR.pack_fingerprint(pack.withColumn("gold_intent", F.lit("refunds")).repartition(3))
    assert mark != FR.pack_fingerprint(pack.withColumn("first_customer_message", F.lit("changed")))


def test_verified_golden(spark):
    assigned = spark.createDataFrame([("a", "golden", "1", "x", "g1", "k1"), ("b", "train", "2", "y", "g2", "k2"), ("c", "dev", "3", "z", "g3", "")], "case_id string, split string, customer_id string, conversation_id string, group_id string, opener_key string")
    golden = assigned.where("split = 'golden'").select("case_id")
    assert all(r.shared == 0 for r in FR.verified_golden(golden, assigned, 1).collect())
    with pytest.raises(FR.NotReady):
        FR.verified_golden(golden, assigned, 2)
    with pytest.raises(FR.NotReady):
        FR.verified_golden(golden, assigned.withColumn("customer_id", F.lit("1")), 1)
    with pytest.raises(FR.NotReady):
        FR.verified_golden(golden, assigned.withColumn("split", F.when(F.col("case_id") == "b", "golden").otherwise(F.col("split"))), 1)


def test_golden_review_wants_every_label(spark):
    pack = spark.createDataFrame([("a", "x", "yes", "other"), ("b", "y", "no", "other")], "case_id string, gold_intent string, gold_should_escalate string, gold_resolution_type string")
    intents = spark.createDataFrame([("a", "p"), ("b", "q")], "case_id string, intent string")
    assert {r.candidate_intent for r in FR.golden_review(pack, intents).collect()} == {"p", "q"}
    with pytest.raises(FR.NotReady):
        FR.golden_review(pack.withColumn("gold_intent", F.when(F.col("case_id") == "a", "x").otherwise("")), intents)
    with pytest.raises(FR.NotReady):
        FR.golden_review(pack, intents.where("case_id = 'a'"))


def test_weak_labels_refuse_golden(spark):
    cases = spark.createDataFrame([("a", 1, "text"), ("b", 2, " "), ("c", 3, "text")], "case_id string, cluster_id int, opening_message string")
    intents = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "cluster_id int, intent string")
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train")], "case_id string, split string")
    assert [tuple(r) for r in FR.weak_labels(cases, intents, split, "train").collect()] == [("a", "train", "text", "p")]
    with pytest.raises(FR.NotReady):
        FR.weak_labels(cases, intents, split, "golden")
    with pytest.raises(ValueError):
        FR.weak_labels(cases, intents, split.union(spark.createDataFrame([("a", "golden")], "case_id string, split string")), "train")


def test_guide_examples(spark):
    cases = spark.createDataFrame([("a", TURNS * 8), ("b", TURNS)], f"case_id string, turns {TURN}")
    split = spark.createDataFrame([("a", "train"), ("b", "dev")], "case_id string, split string")
    none = spark.createDataFrame([], "case_id string")
    ask = lambda *ids: spark.createDataFrame([("s", i, c, " a  reading ") for i, c in enumerate(ids)], "section string, place int, case_id string, reading string")
    one = FR.guide_examples(ask("a"), cases, split, none).collect()[0]
    assert (len(one.turns), one.truncated, one.reading) == (12, True, "a reading")
    with pytest.raises(FR.NotReady, match="b split is dev; z split is unknown"):
        FR.guide_examples(ask("a", "b", "z"), cases, split, none)
    with pytest.raises(FR.NotReady, match="a is a golden"):
        FR.guide_examples(ask("a"), cases, split, cases.where("case_id = 'a'").select("case_id"))


def test_rating_sheets(spark):
    items = spark.createDataFrame([("a", "m", "r", [("old answer",), ("other",)])], "case_id string, message string, reply string, evidence array<struct<historical_response: string>>")
    sheet = FR.rating_sheet(items)
    row = sheet.collect()[0]
    assert row.historical_responses == "old answer || other" and row.human_correctness == "" and "judge" not in "".join(sheet.columns)
    assert FR.rating_sheet(items, sheet).count() == 1
    rated = sheet.withColumns({f"human_{d}": F.lit(" 4 ") for d in FR.JUDGED})
    with pytest.raises(FR.NotReady):
        FR.rating_sheet(items, rated)
    assert FR.human_ratings(sheet).count() == 0 and FR.human_ratings(rated).collect()[0].human_actionability == 4
    with pytest.raises(FR.NotReady):
        FR.human_ratings(rated.withColumn("human_correctness", F.lit("6")))


def test_case_records_stop_at_the_first_failure(spark):
    cases = spark.createDataFrame([(c, i, "text") for i, c in enumerate("abcd")], "case_id string, labeling_order int, text string")
    result = "case_id string, failed boolean, intent string, confidence double, multi_intent boolean, action string, reasons array<string>, reply string, internal_draft_reply string, grounded boolean, unsupported_claims array<string>, evidence array<struct<customer_problem: string, historical_response: string>>"
    rows = [("a", False, "x", 0.9, False, "AUTO_HANDLE", [], "hello", None, True, [], []), ("b", False, "x", 0.9, False, "ESCALATE", ["classification failed: t"], None, "draft", False, ["could not verify"], []), ("c", True, "x", 0.9, False, "ESCALATE", [], None, None, None, None, []), ("d", False, "x", 0.9, False, "ESCALATE", [], None, None, None, None, [])]
    records = FR.case_records(cases, spark.createDataFrame(rows, result), F.array())
    got = {r.case_id: r for r in records.collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"].generation, got["a"].grounding, got["b"].grounding, got["b"].classification_failed) == ("produced", "pass", "unavailable", True)
    items = {r.case_id: r for r in FR.judge_items(records).collect()}
    assert items["a"].sent_to_customer and not items["b"].sent_to_customer and items["b"].reply == "draft"


def test_ablation_compares_indexes(spark):
    queries = spark.createDataFrame([(1, "wifi broken"), (2, "refund please")], "query_id long, text string")
    full = spark.createDataFrame([("a", "the wifi is broken again"), ("b", "refund for my ticket"), ("c", "seat")], "case_id string, text string")
    poor = full.withColumn("text", F.lit("nothing here"))
    right = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, case_id string")
    got = {r["index"]: r for r in FR.ablation(queries, {"full": full, "poor": poor}, right).collect()}
    assert got["full"].recall_at_1 == 1.0 and got["poor"].mrr == 0.0 and got["poor"].n == 2


def test_smoke_text(spark):
    got = spark.createDataFrame([("Hi @acme SEE https://t.co/x #Now  ok",), (None,)], "x string").select(FR.smoke_text(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["hi see ok", ""]


# ---- label state and caches ----

EVENTS = [("a", 1, "draft", "x"), ("a", 2, "save", "x"), ("b", 3, "save", "y"), ("a", 4, "save", "z"), ("c", 5, "save", "q"), ("c", 6, "clear", None), ("b", 7, "clear", None), ("b", 8, "save", "w"), ("d", 9, "draft", "k")]


@pytest.mark.parametrize("cut", range(10))
def test_folding_equals_replay(spark, cut):
    schema = "case_id string, seq long, action string, value string"
    log = spark.createDataFrame(EVENTS, schema)
    state = L.folded(spark.createDataFrame([], ST.STATE), log.where(F.col("seq") <= cut))
    state = L.folded(state, log.where(F.col("seq") >= cut - 1))  # two events come again
    assert sorted(map(tuple, L.standing(state).collect())) == sorted(map(tuple, L.replayed(log).select("case_id", "value", "saves", "provenance").collect()))


def test_label_stream_keeps_the_state(spark, tmp_path):
    schema = "case_id string, seq long, action string, value string"
    for i, part in enumerate((EVENTS[:4], EVENTS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ST.label_upserts(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = L.replayed(spark.createDataFrame(EVENTS, schema)).select("case_id", "value", "saves", "provenance")
    assert sorted(map(tuple, L.standing(ST.label_state(spark, f"{tmp_path}/out")).collect())) == sorted(map(tuple, want.collect()))


def test_embeddings_are_made_once(spark, tmp_path):
    asked = []

    def encoder(rows, text, to):
        asked.append(sorted(r[0] for r in rows.select(text).collect()))
        return H.hashed_encoder(rows, text, to)

    first = spark.createDataFrame([(1, "wifi broken"), (2, "wifi broken"), (3, None)], "id int, t string")
    got = H.embedded(first, "t", encoder, f"{tmp_path}/v").orderBy("id").collect()
    assert got[0].vector == got[1].vector and len(got[0].vector) == 64 and len(got) == 3
    H.embedded(spark.createDataFrame([(1, "wifi broken"), (4, "new words")], "id int, t string"), "t", encoder, f"{tmp_path}/v").collect()
    assert asked == [["", "wifi broken"], ["new words"]]


def test_answers_resume(spark, tmp_path):
    asked = []

    def model(rows):
        asked.append(sorted(r.payload for r in rows.select("payload").collect()))
        return rows.withColumns({"error": F.when(F.col("payload") == "bad", "timeout"), "output": F.when(F.col("payload") != "bad", F.upper("payload"))})

    rows = spark.createDataFrame([("a",), ("a",), ("bad",)], "payload string")
    got = H.answered(rows, model, f"{tmp_path}/c", "m").collect()
    assert sorted((r.payload, r.output, r.error, r.cached) for r in got if r.payload == "a") == [("a", "A", None, False)] * 2
    again = {r.payload: r for r in H.answered(rows, model, f"{tmp_path}/c", "m").collect()}
    assert again["a"].cached and again["bad"].error == "timeout" and asked == [["a", "bad"], ["bad"]]


def test_answers_of_a_stream(spark, tmp_path):
    model = lambda rows: rows.withColumns({"output": F.upper("payload"), "error": F.lit(None).cast("string")})
    spark.createDataFrame([("a",), ("b",)], "payload string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("payload string").parquet(f"{tmp_path}/in")
    H.answered_stream(stream, model, f"{tmp_path}/c", "m", f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.output for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["A", "B"]


def test_lsa_equals_a_singular_value_decomposition(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from turnstone.operators import learning as ML

    x = np.random.default_rng(1).poisson(0.6, (30, 12)).astype(float)
    frame = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(x)], ["id", "weights"])
    got = np.array([r.v for r in ML.lsa(frame, 3).orderBy("id").select(vector_to_array("features").alias("v")).collect()])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(got @ got.T), np.abs(want @ want.T), atol=1e-8)
