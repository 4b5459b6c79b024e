"""Operators on hand-written rows: the awkward cases of threads, episodes, text, statistics."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import episodes as E
from turnstone.operators import graph
from turnstone.operators import labels as L
from turnstone.operators import memory as M
from turnstone.operators import policy as P
from turnstone.operators import retrieval as RT
from turnstone.operators import review as RV
from turnstone.operators import scores as SC
from turnstone.operators import threads as TH
from turnstone.sources import tables as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, source_row long"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def messages(spark, rows):
    """(id, author, inbound, minute or None, text, children, parent)"""
    data = [(i, a, b, None if m is None else T0 + dt.timedelta(minutes=m), t, c, p, n) for n, (i, a, b, m, t, c, p) in enumerate(rows)]
    return spark.createDataFrame(data, "tweet_id long, author_id string, inbound boolean, created_at timestamp, text string, response_tweet_ids array<long>, in_response_to_tweet_id long, source_row long")


# ---- sources ----


def test_csv_keeps_words_that_look_like_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,x,"NA, ""null""\nnext","",\n2,b,False,y,null,,1\n')
    rows = S.read_raw(spark, str(tmp_path / "m.csv")).orderBy("source_row").collect()
    assert [r.text for r in rows] == ['NA, "null"\nnext', "null"] and rows[0].response_tweet_id is None and rows[1].in_response_to_tweet_id == "1"
    with pytest.raises(ValueError):
        S.read_raw(spark, "m.txt")


def test_cleaning(spark):
    rows = [
        ("12.0", "a", "True", "Tue Oct 31 22:10:47 +0000 2017", "first", "1, ,x", "5", 0), (" 12 ", "a", "true", "Tue Oct 31 22:10:47 +0000 2017", "second", None, None, 1), ("12", "a", "True", "Tue Oct 31 22:10:47 +0000 2017", "first", None, None, 2),
        ("12.5", "a", "True", "x", "t", None, None, 3), ("abc", "a", "True", "x", "t", None, None, 4), ("9007199254740993", "a", " FALSE ", "Tue Oct 31 23:40:47 +0130 2017", None, "3,4,", None, 5), ("7", "a", "maybe", "x", "t", None, None, 6),
    ]
    raw = spark.createDataFrame(rows, RAW)
    got = {r.tweet_id: r for r in S.cleaned(raw).collect()}
    assert set(got) == {12, 9007199254740993} and got[12].text == "first" and got[12].response_tweet_ids == [] and got[12].in_response_to_tweet_id == 5
    assert got[9007199254740993].response_tweet_ids == [3, 4] and got[9007199254740993].text == "" and not got[9007199254740993].inbound
    assert got[12].created_at == got[9007199254740993].created_at
    rep = S.cleaning_report(raw).first()
    assert (rep.rows_in, rep.bad_tweet_id, rep.bad_inbound, rep.exact_duplicates, rep.conflicting_duplicates, rep.rows_out) == (7, 2, 1, 1, 1, 2)
    with pytest.raises(S.SchemaError):
        S.validate(raw.drop("text"))
    assert S.cleaned(raw.limit(0)).count() == 0


# ---- text ----


@pytest.mark.parametrize(
    "column, text, want",
    [
        (X.matching_form, "@Acme  It’s &amp; fine https://t.co/x -KC", "it's & fine <url>"), (X.template_key, "DM us your order #123, please do it now and then wait", "dm us your order 0 please do it"),
        (X.display_text, "@a @b 1/2 Hello &lt;you&gt; ^JK", "Hello <you>"), (X.opener_key, "Hi @Bob 12 times! Café https://x.y", "hi 0 times caf"), (X.strip_mentions, "@äb hi @c", "hi"),
        (X.opening_form, "Paid £1,200.50 at 10:45 on Monday in coach B to Milton Keynes #fail", "paid <money> at <time> on <day> in <seat> to <place> fail"),
        (lambda x: X.clip(x, 12), "one two three four", "one two…"), (lambda x: X.clip(x, 5), "abcdefgh", "abcd…"), (lambda x: X.cut_with_ellipsis(x, 4), "abcdef", "abc…"), (X.indexed_text, "see #tag @me http://a.b ok", "see tag ok"),
        (lambda x: F.array_join(X.tokens(x), " "), "The parties' buses aren't working, no status", "party buse arent working no status"), (R.keyword_intent, "please cancel my order", "cancellation"), (R.keyword_intent, None, "other"),
        (lambda x: F.array_join(R.sensitive_words(x), ","), "The POLICE and a lawyer; police", "lawyer,police"), (lambda x: X.count_words(x).cast("string"), "@me don't pay £5 https://x.y #no", "3"),
        (lambda x: F.round(V.confidence(x), 3).cast("string"), "80%", "0.8"), (lambda x: V.confidence(x).cast("string"), "nan", None), (V.label, ' "Delay Repay-claim" ', "delay_repay_claim"), (V.json_object, 'sure: ```{"a": {"b": 1}}``` ok', '{"a": {"b": 1}}'), (V.json_object, "no {broken", None),
    ],
)
def test_text_functions(spark, column, text, want):
    assert one(spark, column, text) == want


def test_latin_share_and_turn_rendering(spark):
    assert one(spark, X.latin_share, "12 !!") == 1.0 and one(spark, X.latin_share, "abé @zz") == pytest.approx(2 / 3)
    df = spark.createDataFrame([([(1, "customer", "hi\nthere"), (22, "brand_agent", "ok")],)], "ts array<struct<id:long,role:string,text:string>>").select("ts", X.parsed_turns(X.render_turns(F.col("ts"))).alias("back"))
    r = df.first()
    assert [tuple(t) for t in r.back] == [tuple(t) for t in r.ts]


def signals(spark, text, operators=()):
    rows = spark.createDataFrame([(1, "brand_agent", text)], "tweet_id long, role string, text string")
    return {s.signal: s.snippet for s in E.with_signals(rows, list(operators)).first().found}


def test_signals(spark):
    assert list(signals(spark, "Sorry. Please DM us your reference! Bye")) == ["redirected_to_dm"] and signals(spark, "Sorry. Please DM us your reference! Bye")["redirected_to_dm"] == "Please DM us your reference!"
    assert "feedback_acknowledged" not in signals(spark, "I have escalated your feedback") and "feedback_acknowledged" in signals(spark, "Your feedback is noted")
    assert "redirected_to_other_operator" in signals(spark, "Please contact @OtherRail about it", ["otherrail"]) and "redirected_to_other_operator" not in signals(spark, "Please contact @OtherRail about it")
    assert list(signals(spark, "The train from here leaves at nine tonight")) == ["information_provided"] and list(signals(spark, "Okay then")) == ["other"] and list(signals(spark, "Which train?")) == ["clarification_requested"]
    assert "account_action" in signals(spark, "We've cancelled your ticket") and "account_action" not in signals(spark, "You can cancel trains")


def cases(spark, *turns):
    data = [(1, i, role, None, text, "c") for i, (role, text) in enumerate(turns)]
    rows = spark.createDataFrame(data, "k long, tweet_id long, role string, created_at timestamp, text string, author_id string")
    return E.resolutions(E.with_signals(rows), "k").first()


def test_case_resolution(spark):
    r = cases(spark, ("customer", "help"), ("brand_agent", "Please DM us"), ("brand_agent", "You're welcome, have a great day"))
    assert (r.outcome, r.dm_redirect, r.resolved) == ("agent_closed", True, True) and r.resolution_type != "redirected_to_dm"
    r = cases(spark, ("customer", "help"), ("brand_agent", "Which train?"), ("customer", "still not working"))
    assert (r.outcome, r.resolution_type, r.resolved) == ("customer_followup_unanswered", "unresolved", False) and r.resolution_evidence[0].signal == "clarification_requested"
    r = cases(spark, ("customer", "help"), ("other_agent", "hi"))
    assert (r.resolution_type, r.dm_redirect, r.resolution_evidence) == ("unresolved", False, [])
    r = cases(spark, ("customer", "thanks"))
    assert (r.outcome, r.resolution_type) == ("no_response", "unresolved")
    assert cases(spark, ("customer", "q"), ("brand_agent", "We refund it"), ("customer", "thanks, sorted")).resolved


def test_a_very_long_case_is_no_array(spark):
    n = 20_000
    text = F.concat(F.lit("We have refunded ticket "), F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, ". Please DM us").otherwise(". Which train?"))
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("tweet_id"), F.when(F.col("id") % 2 == 0, "customer").otherwise("brand_agent").alias("role"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"), text.alias("text"))
    out = E.resolutions(E.with_signals(rows), "k")
    r = out.first()
    assert (r.resolution_type, r.dm_redirect) == ("refund", True) and [e.tweet_id for e in r.resolution_evidence] == [1, 3, 5, 7]
    marked = E.with_signals(rows.withColumn("author_id", F.lit("a")))
    assert "collect_list" not in E.case_table(marked.drop("found"), "k").select("k", "turn_count")._jdf.queryExecution().optimizedPlan().toString()


# ---- graphs and threads ----


def test_components_and_depth_with_cycles(spark):
    edges = [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4)] + [(i, i + 1) for i in range(100, 250)] + [(1000, i) for i in range(1001, 2001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[1] == 1 and got[3] == 2 and got[6] == 4 and got[250] == 100 and got[2000] == 1000 and len(got) == 6 + 151 + 1001
    parents = [(i, i - 1 if i > 100 else None, i == 120) for i in range(100, 251)] + [(1, 1, False), (2, 3, True), (3, 2, False), (4, 5, False), (5, 6, False), (6, 5, False), (7, 999, False)]
    up = {r.node: r for r in graph.ancestors(spark.createDataFrame(parents, "node long, parent long, stop boolean"), "stop").collect()}
    assert (up[250].depth, up[250].top, up[250].found) == (150, 100, 120) and up[119].found is None and up[120].found is None
    assert (up[1].depth, up[7].depth) == (0, 0) and up[3].depth == 1 and up[4].depth == 2 and len(up) == len(parents)


def test_reconstruction(spark):
    m = messages(spark, [
        (30, "a", True, 0, "q", [20], None), (20, "x", False, 1, "r", [], 30), (10, "a", True, 2, "s", [], 20),  # ids against time
        (40, "b", True, 5, "lonely", [999], 888), (51, "c", True, None, "no time", [], 50), (50, "c", True, 9, "root", [51], None), (60, "d", True, 9, "self", [60], 60), (70, "e", True, 1, "p", [71], None), (71, "x", False, 1, "only listed", [], None),
    ])
    got = {r.tweet_id: r for r in TH.reconstructed(m).collect()}
    assert [got[i].turn_index for i in (30, 20, 10)] == [0, 1, 2] and {got[i].conversation_id for i in (30, 20, 10)} == {"conv_30"}
    assert got[40].missing_parent and got[40].conversation_size == 1 and not got[60].missing_parent and got[51].turn_index == 1
    assert (got[71].parent_tweet_id, got[71].parent_source) == (70, "response_list") and len(got) == 9
    stats = TH.reconstruction_stats(m, TH.reconstructed(m)).first()
    assert (stats.threads, stats.dangling, stats.missing_parents, stats.largest) == (5, 1, 1, 3)
    assert TH.reconstructed(m.limit(0)).count() == 0


def test_orphans_follow_mentions(spark):
    rows = [(1, "11", "customer", 0, "help", 3, 1), (2, "brand", "brand_agent", 10, "@11 hello", 1, 2), (3, "11", "customer", 20, "thanks", 1, 3), (4, "brand", "brand_agent", 500, "@11 late", 1, 4), (5, "brand", "brand_agent", 20, "@99 @11 x", 1, 5)]
    df = spark.createDataFrame([(i, a, r, T0 + dt.timedelta(minutes=m), t, n, root, f"conv_{root}", None, None) for i, a, r, m, t, n, root in rows], "tweet_id long, author_id string, role string, created_at timestamp, text string, conversation_size long, root_tweet_id long, conversation_id string, parent_tweet_id long, parent_source string").withColumn("turn_index", F.lit(0))
    # 3 and 5 name each other in the same minute: both are candidates, as equal times count
    assert {r.tweet_id: r.target for r in TH.orphan_links(df).collect()} == {2: 1, 3: 5, 5: 3}


# ---- episodes ----


def threads(spark, rows):
    """(id, author, role, minute, text, parent)"""
    data = [(i, a, r, None if m is None else T0 + dt.timedelta(minutes=m), t, p, "conv_1", r == "customer") for i, a, r, m, t, p in rows]
    return spark.createDataFrame(data, "tweet_id long, author_id string, role string, created_at timestamp, text string, parent_tweet_id long, conversation_id string, inbound boolean")


def test_gap_is_strict_and_tails_merge(spark):
    day = 24 * 60
    rows = [(1, "7", "customer", 0, "q", None), (2, "7", "customer", day, "at the limit", 1), (3, "brand", "brand_agent", 3 * day, "late reply", 2), (4, "8", "customer", 4 * day, "other", 1), (5, "7", "customer", 6 * day, "again", 3), (6, "7", "customer", None, "no time", 5)]
    got = {r.tweet_id: r for r in E.segmented(threads(spark, rows)).collect()}
    assert {got[i].case_id for i in (1, 2, 3)} == {"case_1"} and got[5].case_id == got[6].case_id == "case_5" and got[4].case_id == "case_4"
    assert got[5].continues_case_id == "case_1" and got[1].continues_case_id is None and [got[i].episode_seq for i in (1, 4, 5)] == [0, 1, 2]
    exact = spark.createDataFrame([(1, i, T0 + dt.timedelta(hours=h, microseconds=u)) for i, (h, u) in enumerate([(0, 0), (24, 0), (48, 1)])], "o long, tweet_id long, created_at timestamp").withColumn("reply_depth", F.lit(0))
    assert [r.segment for r in E.gap_segments(exact, ["o"]).orderBy("tweet_id").collect()] == [0, 0, 1]


def test_owners_and_context(spark):
    rows = [(1, "brand", "brand_agent", 0, "announcement", None), (2, "7", "customer", 1, "q", 1), (3, "8", "customer", 2, "me too", 1), (4, "brand", "brand_agent", 3, "hi", 2), (5, "brand", "brand_agent", 4, "@8 hello", 1), (6, "brand", "brand_agent", 5, "bye", 1)]
    out = graph.saved(E.segmented(threads(spark, rows)))
    got = {r.tweet_id: (r.owner_id, r.owner_source, r.exclusion_reason) for r in out.collect()}
    assert got == {1: (None, None, "unattributed_agent_tweet"), 2: ("7", "self", None), 3: ("8", "self", None), 4: ("7", "parent_chain", None), 5: ("8", "mention", None), 6: (None, None, "unattributed_agent_tweet")}
    assert {r.case_id: r.context_tweet_ids for r in E.context_ids(out).collect()} == {"case_2": [1], "case_3": [1]}
    sole = {r.tweet_id: r.owner_source for r in E.segmented(threads(spark, rows[:2])).collect()}
    assert sole == {1: "sole_customer", 2: "self"}
    same = [(9, "7", "customer", 0, "q", None), (8, "brand", "brand_agent", 0, "r", 9)]
    assert E.turns_of(E.segmented(threads(spark, same)), "case_id").first().turns[0].tweet_id == 9  # parent first in the same second


def test_every_owned_message_is_in_one_case(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(int(rng.integers(1, 4))), "customer", int(rng.integers(0, 9000)), "t", None if i == 0 else int(rng.integers(0, i))) for i in range(60)]
    rows = [r if i % 3 else (r[0], "brand", "brand_agent", *r[3:]) for i, r in enumerate(rows)]
    for gap in (1.0, 48.0):
        got = E.segmented(threads(spark, rows), gap).collect()
        assert len(got) == 60 and all((r.owner_id is None) == (r.case_id is None) for r in got)
    table = E.case_table(graph.saved(E.segmented(threads(spark, rows), 48.0)))
    assert table.agg(F.sum("turn_count")).first()[0] == sum(r.case_id is not None for r in got)


def test_related_cases_and_brand(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    c = spark.createDataFrame([("a", "u", h(0), h(1)), ("b", "u", h(25), h(26)), ("c", "u", h(60), h(61)), ("d", "u", None, None), ("e", "v", h(0), h(1))], "case_id string, customer_id string, first_timestamp timestamp, last_timestamp timestamp")
    assert {r.case_id: r.related_case_ids for r in E.related_cases(c).collect()} == {"a": ["b"], "b": ["a"], "c": [], "d": [], "e": []}
    m = messages(spark, [(1, "x", False, 0, "t", [], None), (2, "y", False, 1, "t", [], None), (3, "y", False, 2, "t", [], None)]).withColumn("conversation_id", F.lit("c1"))
    n = messages(spark, [(4, "7", True, 0, "hi @Y", [], None), (5, "8", True, 0, "hi", [], None)]).withColumn("conversation_id", F.concat(F.lit("c"), F.col("tweet_id").cast("string")))
    assert {r.conversation_id: r.brand for r in E.attributed_brand(m.unionByName(n)).collect()} == {"c1": "y", "c4": "y", "c5": "unknown"}


def test_brand_selection_and_hidden_agents(spark):
    rows = [(1, "7", True, 0, "hello @acme!", [], None), (2, "8", True, 0, "hello @acmeco", [], None), (3, "Acme", False, 0, "hi", [], None), (4, "rail", False, 0, "@acme x", [], None)] + [(10 + i, "h", True, 0, "done ^KC" if i < 4 else "no", [], None) for i in range(5)]
    m = messages(spark, rows).withColumn("conversation_id", F.col("tweet_id").cast("string"))
    assert {r.tweet_id for r in TH.brand_threads(m, "acme").collect()} == {1, 3}
    assert [(r.author_id, r.n, r.rate) for r in TH.hidden_agents(m).collect()] == [("h", 5, 0.8)]
    roles = {r.tweet_id: r.role for r in TH.with_roles(m, "acme", TH.hidden_agents(m)).collect()}
    assert (roles[1], roles[3], roles[10]) == ("customer", "other_agent", "other_agent")


# ---- statistics ----


def test_percent_rank_and_kappa_edges(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "i int, x double")
    assert {r.i: r.pct_x for r in SC.percent_rank_avg(df, ["x"]).collect()} == {1: 2.5 / 3, 2: 2.5 / 3, 3: 1 / 3, 4: None}
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert SC.cohen_kappa(same, "a", "b").first().kappa is None and SC.weighted_kappa(same, "a", "b").first().kappa is None and SC.spearman(same, "a", "b").first().rho is None
    half = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
    assert SC.weighted_kappa(half, "a", "b").first().kappa == pytest.approx(0.0)
    assert SC.report(spark.createDataFrame([("a", "b")], "g string, p string"), "g", "p").first()[2:] == (0.0, 0.0, 0.0)
    assert SC.majority_label(spark.createDataFrame([("b",), ("a",)], "l string"), "l").first().label == "a"
    r = P.routing_metrics(spark.createDataFrame([], "action string, should_escalate boolean")).first()
    assert r.n == 0 and r.escalation_coverage is None and r.false_auto_handle is None


def test_splits_are_leak_free(spark):
    n = 400
    cases = spark.createDataFrame([(f"c{i}", f"key{i % 90}" if i % 3 else "", [i // 2]) for i in range(n)], "case_id string, opener_key string, message_ids array<long>")
    groups = spark.createDataFrame([(f"c{i}", i // 4) for i in range(n)], "case_id string, group_id long")
    gold = spark.createDataFrame([(f"c{i}",) for i in range(0, n, 40)], "case_id string")
    out = SC.split_assignments(cases, groups, gold)
    assert out.count() == n
    joined = out.join(cases, "case_id").withColumn("message", F.col("message_ids")[0]).withColumn("opener", F.nullif("opener_key", F.lit("")))
    assert {r.shared for r in SC.leakage(joined, ["case_id", "opener", "message"]).collect()} == {0}
    by_group = out.join(groups, "case_id").where("split in ('train', 'dev', 'reserve')").groupBy("group_id").agg(F.count_distinct("split").alias("k"))
    assert by_group.agg(F.max("k")).first()[0] == 1
    assert SC.split_assignments(cases, groups, gold.limit(0)).where("reason <> ''").count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 90 else "c", i % 7) for i in range(100)], "id long, kind string, size int")
    s = SC.diverse_sample(df, "id", ["kind", "size"], 30).collect()
    assert len(s) == 30 and {r.kind for r in s} == {"a", "b", "c"} and sorted(s) == sorted(SC.diverse_sample(df, "id", ["kind", "size"], 30).collect())
    assert SC.diverse_sample(df, "id", ["kind"], 500).count() == 100
    assert SC.quotas(df.groupBy("kind").agg(F.count("*").alias("n")), "kind", 20).agg(F.sum("quota")).first()[0] == 20
    c = RV.calibration_sample(df.withColumn("margin", F.col("id") / 100.0), "id", "kind", "margin", 20).collect()
    assert len(c) == 20 and {r.reason for r in c} == {"low_margin", "diverse"}
    picks = RV.scenario_picks(df, "id", {"big": F.col("id"), "bigger": F.col("id") + 1}).collect()
    assert [r.id for r in picks] == [99, 98]


def plain_diverse(rows, dims, n):
    """The greedy walk over all combinations."""
    cells = {}
    for r in rows:
        c = tuple(r[1:])
        cells[c] = cells.get(c, 0) + 1
    levels = [{} for _ in dims]
    for c, k in cells.items():
        for i, v in enumerate(c):
            levels[i][v] = levels[i].get(v, 0) + k
    target = [{v: max(1.0, n * k**0.5 / sum(x**0.5 for x in lv.values())) for v, k in lv.items()} for lv in levels]
    taken, quota = [dict.fromkeys(lv, 0) for lv in levels], dict.fromkeys(cells, 0)
    for _ in range(min(n, len(rows))):
        best = max((c for c in cells if quota[c] < cells[c]), key=lambda c: (round(sum(1 - taken[i][v] / target[i][v] for i, v in enumerate(c)), 9), tuple("" if v is None else str(v) for v in c)))
        quota[best] += 1
        for i, v in enumerate(best):
            taken[i][v] += 1
    return {c: q for c, q in quota.items() if q}


@pytest.mark.parametrize("heap", [3, 7, 1000])
def test_lazy_sample_equals_the_greedy_walk(spark, heap):
    import random

    rng = random.Random(9)
    rows = [(i, rng.choice("aabbbcd") if i % 9 else None, rng.randrange(0, 6), rng.choice(["x", "y"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, kind string, size int, side string")
    for n in (0, 1, 25, 500):
        got = {}
        for r in SC.diverse_sample(df, "id", ["kind", "size", "side"], n, heap=heap).collect():
            got[(r.kind, r["size"], r.side)] = got.get((r.kind, r["size"], r.side), 0) + 1
        assert got == plain_diverse(rows, ["kind", "size", "side"], n)
        if heap < 1000 and n == 25:
            break


def test_rare_pairs_are_sketched_away(spark):
    from turnstone.operators import vocabulary as VO

    rows = [(i, f"common word r{i} s{i} often seen" if i % 2 else f"q{i} often seen x{i % 7}") for i in range(120)] + [(500, None), (501, "")]
    docs, tokens = spark.createDataFrame(rows, "id long, text string"), F.split("text", " ")
    want = {}
    for _, t in rows:
        w = t.split(" ") if t is not None else []
        for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}:
            want[g] = want.get(g, 0) + 1
    for width in (4, 64, 1 << 20):
        got = {r.term: r.df for r in VO.gram_vocabulary(docs, tokens, min_df=6, max_df=0.6, width=width).collect()}
        assert got == {g: k for g, k in want.items() if 6 <= k <= 0.6 * len(rows)}
    seen = docs.select(F.explode(F.array_distinct(RT.bigrams(tokens))).alias("term"))
    assert VO.proposed(seen, VO.heavy_buckets(seen, 6)).count() == sum(k for k in want.values() if k >= 6)  # nothing rare is left to shuffle
    plan = VO.proposed(seen, VO.heavy_buckets(seen, 6)).groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    weights = VO.weighed(docs, "id", tokens, VO.gram_vocabulary(docs, tokens, min_df=6, max_df=0.6)).collect()
    norms = {}
    for r in weights:
        norms[r.id] = norms.get(r.id, 0) + r.weight**2
    assert all(abs(x - 1) < 1e-9 for x in norms.values()) and {r.term for r in weights} == {g for g, k in want.items() if 6 <= k <= 0.6 * len(rows)}


def test_retrieval(spark):
    corpus = spark.createDataFrame([("a", "wifi not working"), ("b", "seat booking"), ("c", "wifi")], "case_id string, text string")
    queries = spark.createDataFrame([(1, "my wifi is not working"), (2, "the and of"), (3, "seats"), (4, "zebra")], "query_id long, text string")
    got = RT.search(queries, corpus).collect()
    assert {r.query_id for r in got} == {1, 3} and [r.case_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1] == ["a", "c"] and [r.low_information for r in got if r.query_id == 3] == [True]
    with pytest.raises(ValueError):
        RT.search(queries, corpus.limit(0))
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 3.0), (2, "b", 1.0)], "q long, d string, s double")
    assert {(r.q, r.d): r.m for r in s.withColumn("m", RT.min_max("s", "q")).collect()} == {(1, "a"): 0.0, (1, "b"): 0.0, (2, "a"): 1.0, (2, "b"): 0.0}
    assert {(r.q, r.d): r.m for r in s.withColumn("m", RT.min_max("s", "q", 3)).collect()}[(1, "a")] == 1.0
    ranked = spark.createDataFrame([(1, i, i == 3) for i in range(1, 5)], "q long, rank int, rel boolean")
    m = RT.metrics(RT.best_relevant(ranked, "q", "rel")).first()
    assert (m.recall_at_1, m.recall_at_3, m.mrr, m.precision_at_5) == (0.0, 1.0, pytest.approx(1 / 3), 0.25)
    bonus = spark.createDataFrame([("x", "x"), ("unclear_or_media_only", "unclear_or_media_only"), (None, "x"), ("", "")], "q string, d string").select(RT.intent_bonus(F.col("q"), F.col("d")).alias("b"))
    assert [r.b for r in bonus.collect()] == [0.15, 0.0, 0.0, 0.0]


def test_policy_thresholds(spark):
    case = spark.createDataFrame([(1, "my seat was taken today", "seat", 0.9, False), (2, "hi", "seat", 0.9, False), (3, "my seat was taken today", "seat", 0.9, False), (4, "my seat was taken today", "seat", 0.9, False)], "case_id long, message string, intent string, confidence double, multi_intent boolean")
    ev = [(i, 0.7, "seat", "we moved your seat booking", "account_action", "none") for i in (1, 1, 1, 2, 2, 2, 4)]
    got = {r.case_id: r for r in P.decided(case, spark.createDataFrame(ev, "case_id long, similarity double, intent string, response string, resolution_type string, escalation_signal string")).collect()}
    assert (got[1].action, got[1].decision_confidence, got[1].reasons) == ("AUTO_HANDLE", 0.7, [])
    assert (got[2].reasons, got[2].decision_confidence) == (["low_information"], 1.0) and got[3].reasons == ["no_evidence"] and got[4].reasons == ["insufficient_evidence"]


# ---- memory and labels ----


def test_memory_text(spark):
    turns = [(1, "customer", "@acme my seat https://x.y is gone"), (2, "customer", "really"), (3, "brand_agent", "Ok ^KC"), (4, "brand_agent", "We have moved your booking to coach B"), (5, "customer", "thanks")]
    ev = [(4, "account_action", "We have moved")]
    r = spark.createDataFrame([(turns, ev)], "turns array<struct<tweet_id:long,role:string,text:string>>, ev array<struct<tweet_id:long,signal:string,snippet:string>>").select(
        M.customer_problem(F.col("turns")).alias("p"), M.response_turns(F.col("turns"), F.col("ev"), F.lit("account_action")).alias("c"), M.historical_response(M.response_turns(F.col("turns"), F.col("ev"), F.lit("refund"))).alias("h"),
        M.summary(F.lit("account_action"), F.lit("agent_closed"), F.col("ev"), F.lit(True)).alias("s"), M.escalation_signal(F.array(F.lit("redirected_to_dm"), F.lit("escalated"))).alias("e"),
    ).first()
    assert r.p == "my seat is gone really" and [t.tweet_id for t in r.c] == [4] and r.h.startswith("We have moved") and r.e == "customer_relations_or_formal_route"
    assert r.s == 'Agent said it changed or issued something on the booking; agent closed the thread. The agent also asked to move to DM. Key line: "We have moved"'


def test_label_replay_and_decisions(spark):
    log = [("a", 1, "draft", "x"), ("a", 2, "save", "x"), ("b", 1, "draft", "x"), ("b", 2, "save", "y"), ("c", 1, "save", "x"), ("d", 1, "save", "x"), ("d", 2, "clear", None), ("e", 1, "draft", "x"), ("f", 1, "save", "x"), ("f", 2, "clear", None), ("f", 3, "save", "z")]
    got = {r.case_id: (r.value, r.provenance) for r in L.replayed(spark.createDataFrame(log, "case_id string, seq long, action string, value string")).collect()}
    assert got == {"a": ("x", "confirmed"), "b": ("y", "corrected"), "c": ("x", "human"), "e": ("x", "draft"), "f": ("z", "human")}


def plain_decisions(decisions, labels, fallback):
    """Each decision applied to all labels, one after another."""
    now = {x: x for x in labels}
    for d in decisions:
        if d["action"] in ("merge", "rename", "drop"):
            now = {x: (d.get("to") or fallback) if y in d["from"] else y for x, y in now.items()}
    return now


def test_decisions_fold_in_order(spark):
    labels = ["a", "b", "c", "d", "e", "f"]
    decisions = [
        {"action": "merge", "from": ["a", "b"], "to": "ab"}, {"action": "rename", "from": ["ab"], "to": "x"}, {"action": "new", "to": "n"}, {"action": "drop", "from": ["c"]},
        {"action": "merge", "from": ["x", "d"], "to": "d"}, {"action": "rename", "from": ["e"], "to": "a"}, {"action": "rename", "from": ["d"], "to": "b"}, {"action": "edit", "from": ["f"]},
    ]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r.final for r in L.label_map(frame, L.decision_steps(spark, decisions, "other")).collect()}
    assert got == plain_decisions(decisions, labels, "other") == {"a": "b", "b": "b", "c": "other", "d": "b", "e": "a", "f": "f"}
    assert L.decision_errors(decisions, labels) == []
    errors = L.decision_errors([{"action": "drop", "from": ["zz"]}, {"action": "bad"}, {"action": "rename", "from": ["a"], "to": "b"}, {"action": "merge", "from": ["a"]}, {"action": "new", "to": "c"}], labels)
    assert errors == ["0: unknown intent zz", "1: unknown action 'bad'", "2: b exists", "3: unknown intent a", "3: merge needs a target", "4: c exists"]
    long = [{"action": "rename", "from": [f"s{i}"], "to": f"s{i + 1}"} for i in range(60)]
    assert L.label_map(spark.createDataFrame([("s0",), ("s59",), ("s60",)], "label string"), L.decision_steps(spark, long, "other")).where("final <> 's60'").isEmpty()


def test_shares_and_examples_merge(spark):
    mapped = spark.createDataFrame([("a", "ab"), ("b", "ab"), ("c", "c")], "label string, final string")
    shares = spark.createDataFrame([("a", 3, "k", 1.0), ("b", 1, "j", 0.5), ("b", 1, "k", 0.5), ("c", 0, "k", 1.0)], "label string, n long, kind string, share double")
    got = {(r.final, r.kind): (r.n, r.share, r.place) for r in L.merged_shares(shares, mapped).collect()}
    assert got == {("ab", "k"): (4, 0.875, 1), ("ab", "j"): (4, 0.125, 2), ("c", "k"): (0, 0.0, 1)}
    examples = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 1, "1"), ("b", 2, "4")], "label string, order long, example string")
    assert [r.example for r in L.merged_examples(examples, mapped).orderBy("place").collect()] == ["1", "3", "2", "4"]
    assert L.content_hash({"b": 1, "a": 2}) == L.content_hash({"a": 2, "b": 1})


def test_matching_equals_the_greedy_walk(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        scores = [(c, x, rng.randrange(0, 9) / 8) for c in range(12) for x in "abcdefgh" if rng.random() < 0.8]
        want, labels = {}, set()
        for s, c, x in sorted(((s, c, x) for c, x, s in scores), reverse=True):
            if s >= 0.35 and c not in want and x not in labels:
                want[c] = x
                labels.add(x)
        assert {r.cluster: r.label for r in L.matched_labels(spark.createDataFrame(scores, "cluster long, label string, score double")).collect()} == want
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "cluster long, term string")
    anchors = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "q")], "label string, anchor string")
    assert {r.cluster: r.label for r in L.matched_labels(L.anchor_scores(terms, anchors)).collect()} == {1: "x", 2: "y"}
    assert L.matched_labels(L.anchor_scores(terms, anchors).where("score > 9")).collect() == []


def test_walks_around_cycles(spark):
    import random

    rng = random.Random(4)
    parents = {i: rng.choice([None, *range(40)]) if i % 5 else (i + 7) % 40 for i in range(40)} | {50: 50, 51: 50, 60: 61, 61: 62, 62: 60, 63: 60, 64: 63, 70: 99}
    stops = {i: rng.random() < 0.3 for i in parents}
    frame = spark.createDataFrame([(i, p, stops[i]) for i, p in parents.items()], "node long, parent long, stop boolean")
    want = {}
    for i in parents:
        seen, at = [i], i
        while (up := parents[at]) is not None and up in parents and up not in seen:
            seen.append(up)
            at = up
        around = seen + ([up] if up in seen and up != at else [])  # the walk may come back to itself
        want[i] = (len(seen) - 1, at, next((x for x in around[1:] if stops[x]), None))
    got = {r.node: (r.depth, r.top, r.found) for r in graph.ancestors(frame, "stop").collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert got == want


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    n, calls, real = 5000, [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: calls.append(1) or real(df))
    ring = spark.range(n).select(F.col("id").alias("node"), ((F.col("id") + 1) % n).alias("parent"))
    out = graph.ancestors(ring)
    assert out.agg(F.min("depth"), F.max("depth"), F.count("*")).first() == (n - 1, n - 1, n) and out.where("top <> pmod(node - 1, 5000)").isEmpty()
    assert len(calls) <= 20


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "case_id long"), spark.createDataFrame([(2,)], "case_id long")
    with pytest.raises(ValueError):
        S.require_disjoint(a, b)
    with pytest.raises(ValueError):
        S.require_unique(a.union(b), "case_id")
    assert S.require_disjoint(a, b.where("case_id > 5")).count() == 2
    assert math.isclose(spark.range(1).select(V.hash_fraction(F.lit("42:7")).alias("u")).first().u, int(__import__("hashlib").sha256(b"42:7").hexdigest()[:12], 16) / 16**12)


def test_streams_agree_with_batch(spark, tmp_path):
    from turnstone.streaming import messages as ST

    rows = [(1, 10, T0), (1, 11, T0 + dt.timedelta(hours=24)), (1, 12, T0 + dt.timedelta(hours=49)), (2, 13, T0), (2, 13, T0)]
    frame = spark.createDataFrame(rows, "owner long, tweet_id long, created_at timestamp")
    late = spark.createDataFrame([(9, 99, T0 + dt.timedelta(days=30))], frame.schema)
    frame.write.parquet(str(tmp_path / "in" / "a"))
    late.write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ST.episodes(stream, "owner", "created_at").writeStream.outputMode("append").format("memory").queryName("eps").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.owner, r.n) for r in spark.sql("select * from eps").collect() if r.owner != 9)
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_split_files_and_configuration(spark, tmp_path):
    from turnstone.sources import splits as SP

    rows = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "dev")], "case_id string, split string")
    m = SP.write_splits(rows, str(tmp_path / "s"))
    assert m == SP.read_manifest(spark, str(tmp_path / "s")) and {k: v["rows"] for k, v in m.items()} == {"train": 2, "dev": 1}
    folder = str(tmp_path / "s")
    assert sorted((r.split, r.reason) for r in SP.read_assignments(spark, folder).collect()) == [("dev", None), ("train", None), ("train", None)]
    import hashlib
    from pathlib import Path

    files = {f: h for f, h in SP.read_manifest(spark, folder, "files").items() if f.endswith((".parquet", ".csv"))}
    assert files and all(hashlib.sha256(Path(folder, f).read_bytes()).hexdigest() == h for f, h in files.items())
    assert SP.verified_splits(spark, folder) == []
    one = sorted(f for f in files if f.startswith("assignments/"))[0]
    Path(folder, one).write_text("case_id,split,reason\n1,dev,\n")
    Path(folder, "assignments", f".{one.split('/')[1]}.crc").unlink()
    Path(folder, "data", "more.parquet").write_bytes(b"x")
    assert SP.verified_splits(spark, folder) == [f"{one}: changed", "data/more.parquet: added"]
    Path(folder, "data", "more.parquet").unlink()
    assert spark.read.parquet(str(tmp_path / "s" / "data")).where("split = 'dev'").count() == 1
    (tmp_path / "c.json").write_text('{"policy": {"min": 3}}')
    assert SP.read_config(spark, str(tmp_path / "c.json")) == {"policy": {"min": 3}}


def test_hashed_vectors_are_unit_or_zero(spark):
    from turnstone.operators import taxonomy as TX

    got = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>").select(TX.hashed_vector(F.col("t")).alias("v")).collect()
    assert math.isclose(sum(x * x for x in got[0].v), 1.0) and set(got[1].v) == {0.0} and len(got[0].v) == 64


def test_normalised_classification_and_status(spark):
    c = spark.createDataFrame([(1, "Refunds", "80", "nope"), (2, "weather", "0.9", "refunds"), (3, "refunds", None, "refunds")], "i int, intent string, confidence string, alternative string")
    got = {r.i: (r.intent, r.confidence, r.alternative) for r in RV.normalised_classification(c, spark.createDataFrame([("refunds",)], "intent string")).collect()}
    assert got == {1: ("refunds", 0.8, None), 2: ("unclear_or_media_only", 0.0, "refunds"), 3: ("refunds", 0.0, None)}
    s = spark.createDataFrame([(3, 0, 0, 3), (0, 2, 0, 3), (2, 1, 0, 3), (2, 0, 0, 3)], "p int, f int, u int, e int").select(RV.status(F.col("p"), F.col("f"), F.col("u"), F.col("e")).alias("s"))
    assert [r.s for r in s.collect()] == ["PASS", "FAIL", "PARTIAL", "PARTIAL"]
    bad = spark.range(1).select(L.label_errors(F.lit(" "), F.lit("x"), F.lit(None).cast("string"), ["a"], ["b"]).alias("e"), L.case_status(F.lit("a"), F.lit(None).cast("string")).alias("s")).first()
    assert bad.e == ["intent_missing", "resolution_unknown", "escalate_not_yes_or_no"] and bad.s == "partial"
