"""Queries over resolution memory, reviews, clusters and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import agent as AG
from turnstone.operators import episodes as E
from turnstone.operators import graph
from turnstone.operators import labels as L
from turnstone.operators import learning as ML
from turnstone.operators import models as MD
from turnstone.operators import memory as M
from turnstone.operators import policy as P
from turnstone.operators import review as RV
from turnstone.operators import taxonomy as TX
from turnstone.plans.bindings import TURNS, read, threads, turns
from turnstone.plans.messages import _NORM, _SHOWN
from turnstone.plans.scores import _TOKENS, _U12, _decided, _DECIDE, _labels, _LABELS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _memory(spark, d):
    rows = graph.saved(E.segmented(threads(spark, d)))
    cases = E.case_table(rows, operators=["55555"]).join(E.context_ids(rows), "case_id")
    per = rows.where("case_id is not null").groupBy("case_id").agg(F.min("conversation_id").alias("conversation_id"), F.max(F.col("continues_case_id").isNotNull()).alias("is_continuation"))
    cases = graph.saved(cases.join(per, "case_id"))
    number = F.regexp_extract("case_id", r"(\d+)", 1).cast("long")
    clusters = cases.select("case_id", (number % 4).cast("int").alias("cluster_id"))
    intents = spark.createDataFrame([(0, "refunds"), (1, "access"), (2, "unclear_or_media_only"), (3, None)], "cluster_id int, intent string")
    splits = cases.select("case_id", F.when(number % 5 == 0, "dev").otherwise("train").alias("split"))
    return M.built(cases, clusters, intents, splits)


@query()
def t31_memory_records(spark, d):
    m = _memory(spark, d)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return m.select(*[listed(c) if c.endswith("_ids") else F.col(c) for c in m.columns])


@query()
def p9_evidence_quality(spark, d):
    return _memory(spark, d).groupBy("evidence_quality", "exclusion_reason").agg(F.count("*").alias("n"))


@query(rf"""WITH {TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts IS NULL, ts, tweet_id) AS k FROM turns), b AS (SELECT conv_id, min(k) AS k FROM o WHERE role = 'brand_agent' GROUP BY conv_id),
c AS (SELECT o.conv_id, o.k, trim(regexp_replace(regexp_replace({_SHOWN.format(x='text')}, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM o WHERE role = 'customer'),
p AS (SELECT conv_id, string_agg(x, ' ' ORDER BY k) AS problem FROM c LEFT JOIN b USING (conv_id) WHERE b.k IS NULL OR c.k < b.k GROUP BY conv_id)
SELECT t.conv_id, coalesce(p.problem, f.x, '') AS problem FROM (SELECT DISTINCT conv_id FROM turns) t LEFT JOIN p USING (conv_id) LEFT JOIN (SELECT conv_id, min_by(x, k) AS x FROM c GROUP BY conv_id) f USING (conv_id)""".replace("c LEFT JOIN b USING (conv_id) WHERE b.k", "(SELECT c.conv_id, c.k, c.x, b.k AS bk FROM c LEFT JOIN b ON b.conv_id = c.conv_id) WHERE bk").replace("OR c.k < b.k", "OR k < bk"))
def t19_customer_problems(spark, d):
    t = E.turns_of(turns(spark, d), "conv_id")
    return t.select("conv_id", M.customer_problem(F.col("turns")).alias("problem"))


@query(f"""WITH {_DECIDE} SELECT 'needless_escalation' AS mode, count(*) FILTER (action = 'ESCALATE' AND NOT should_escalate) AS n FROM dec UNION ALL SELECT 'missed_escalation', count(*) FILTER (action = 'AUTO_HANDLE' AND should_escalate) FROM dec UNION ALL SELECT 'hard_rule_gap', count(*) FILTER (action = 'AUTO_HANDLE' AND should_escalate AND reasons = '') FROM dec""")
def a24_failure_modes(spark, d):
    r = _decided(spark, d).withColumns({"gold_intent": F.col("intent"), "error": F.lit(None).cast("string"), "reply": F.lit("x")})
    return RV.failure_modes(r).where("mode in ('needless_escalation', 'missed_escalation', 'hard_rule_gap')")


_RULE = rf"(gold = '3' OR {' OR '.join(f"regexp_matches(lower(message), '{p}')" for p in R.SENSITIVE)} OR words < 3)"
_WORDS = r"len(regexp_extract_all(regexp_replace(message, 'https?://\S+|[@#]\w+', ' ', 'g'), '[A-Za-z0-9£'']+'))"


@query(f"""WITH {_DECIDE}, c AS (SELECT conv_id, message, {_WORDS} AS words, conv_id % 3 <> 0 AS blind, (conv_id * 7 % 4)::VARCHAR AS gold, CASE WHEN conv_id % 12 <> 0 THEN (conv_id % 5)::VARCHAR END AS said, 0.5 + (conv_id % 11) / 20.0 AS confidence, conv_id % 5 < 3 AS should_escalate, conv_id % 8 = 0 OR conv_id % 13 > 10 AS other FROM m),
w AS (SELECT *, blind AND said IS NOT NULL AS judged, blind AND coalesce(said <> gold, false) AS wrong FROM c), p AS (SELECT least(gold, said) || '|' || greatest(gold, said) AS pair, count(*) AS k FROM w WHERE wrong GROUP BY pair),
r AS (SELECT *, conv_id % 4 AS g, conv_id % 5 AS h, string_split(reasons, ',') AS rs FROM dec)
SELECT 'intent_errors' AS mode, count(*) FILTER (wrong) AS n, count(*) FILTER (judged) AS "of" FROM w UNION ALL SELECT 'confident_errors', count(*) FILTER (wrong AND confidence >= 0.9), count(*) FILTER (wrong) FROM w
UNION ALL SELECT 'policy_over_escalation', count(*) FILTER (blind AND NOT should_escalate AND {_RULE}), count(*) FILTER (blind AND NOT should_escalate) FROM w UNION ALL SELECT 'unsafe_auto_handle', count(*) FILTER (blind AND should_escalate AND NOT {_RULE}), count(*) FILTER (blind AND should_escalate) FROM w
UNION ALL SELECT 'other_operator', count(*) FILTER (other), count(*) FROM w UNION ALL SELECT 'low_information', count(*) FILTER (gold = '2'), count(*) FROM w UNION ALL SELECT 'short_openings', count(*) FILTER (words < 3), count(*) FROM w
UNION ALL SELECT 'intent_boundary', (SELECT coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM p ORDER BY k DESC, pair LIMIT 4)), (SELECT coalesce(sum(k), 0)::BIGINT FROM p)
UNION ALL SELECT 'observed_over_escalation', count(*) FILTER (NOT should_escalate AND action = 'ESCALATE'), count(*) FILTER (NOT should_escalate) FROM r UNION ALL SELECT 'observed_unsafe', count(*) FILTER (should_escalate AND action = 'AUTO_HANDLE'), count(*) FROM r
UNION ALL SELECT 'generation_failures', count(*) FILTER (g IN (2, 3)), count(*) FILTER (g <> 0) FROM r UNION ALL SELECT 'grounding_failures', count(*) FILTER (h IN (2, 3)), count(*) FILTER (h <> 0) FROM r
UNION ALL SELECT 'insufficient_evidence', count(*) FILTER (list_has_any(rs, ['weak_retrieval', 'insufficient_evidence', 'intent_disagreement'])), count(*) FROM r UNION ALL SELECT 'retrieval_misses', count(*) FILTER (conv_id % 10 = 0 OR conv_id % 9 + 1 > 5), count(*) FROM r""")
def a24_failure_report(spark, d):
    """Every failure mode over all conversations: labels, predictions and run outcomes follow from their numbers."""
    c = F.col("conv_id")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    cases = turns(spark, d).where("turn = 0").select(
        F.col("text").alias("message"), (c % 3 != 0).alias("blind"), (c * 7 % 4).cast("string").alias("gold_intent"), F.when(c % 12 != 0, (c % 5).cast("string")).alias("predicted"), (0.5 + (c % 11) / 20.0).alias("confidence"), (c % 5 < 3).alias("should_escalate"),
        F.when(c % 8 == 0, "Run by Another Operator").alias("notes"), F.when(c % 13 > 10, c % 13).alias("other_agent_turns"),
    )
    records = _decided(spark, d).select("conv_id", "action", "should_escalate", "reasons", pick(("not_attempted", "ok", "declined", "error"), c % 4).alias("generation"), pick(("not_run", "pass", "fail", "unavailable", "pass"), c % 5).alias("grounding"))
    searches = records.select(F.when(c % 10 != 0, c % 9 + 1).alias("best"))
    return RV.failure_report(cases, records, searches, blocked=("3",), unclear="2")


@query(f"WITH {_DECIDE} SELECT conv_id, CASE WHEN action = 'AUTO_HANDLE' THEN 'answered' ELSE 'escalated' END AS status FROM dec")
def r9_ticket_status(spark, d):
    return _decided(spark, d).select("conv_id", L.ticket_status(F.col("action"), F.lit("reply")).alias("status"))


@query(f"""WITH {_DECIDE}, found AS (SELECT conv_id, count(*) AS n, count(*) FILTER (e.intent <> conv_id % 4) AS other FROM e GROUP BY conv_id), most AS (SELECT conv_id, max(n) AS common FROM (SELECT conv_id, resolution_type, count(*) AS n FROM e GROUP BY ALL) GROUP BY conv_id),
w AS (SELECT conv_id, len(regexp_extract_all(regexp_replace(text, 'https?://\\S+|[@#]\\w+', ' ', 'g'), '[A-Za-z0-9£'']+')) AS words FROM turns WHERE turn = 0)
SELECT dec.conv_id, concat_ws(',', CASE WHEN dec.conv_id % 4 <> dec.conv_id % 3 THEN 'intent_differs_from_candidate' END, CASE WHEN n IS NULL THEN 'no_evidence' END, CASE WHEN common / n < 0.5 THEN 'mixed_resolutions' END, CASE WHEN other / n > 0.5 THEN 'mostly_other_intents' END,
 CASE WHEN words < 3 THEN 'low_information' END, CASE WHEN dec.conv_id % 7 = 0 THEN CASE WHEN action = 'AUTO_HANDLE' THEN 'multi_intent_flagged' ELSE 'multi_intent_escalation' END END, CASE WHEN dec.conv_id % 4 = 3 THEN 'fallback_intent' END, CASE WHEN dec.conv_id % 5 = 0 THEN 'grounding_failed' END, CASE WHEN action = 'AUTO_HANDLE' AND dec.conv_id % 2 = 0 THEN 'auto_on_escalation_like_case' END) AS flags
FROM dec JOIN w USING (conv_id) LEFT JOIN found USING (conv_id) LEFT JOIN most USING (conv_id)""")
def m17_observation_flags(spark, d):
    c = F.col("conv_id")
    cases = _decided(spark, d).withColumns({"candidate_intent": (c % 3).cast("string"), "grounded": c % 5 != 0, "escalation_signal": F.lit("none"), "dm_redirect": c % 2 == 0})
    t = turns(spark, d)
    e = t.select((c - 1).alias("conv_id"), (F.col("tweet_id") * -1).alias("evidence_case_id"), ((F.col("turn") * 3 + c) % 4).cast("string").alias("intent"), F.col("role").alias("resolution_type"))
    return P.observation_flags(cases, e, fallback="3", key="conv_id").select("conv_id", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {_DECIDE} SELECT conv_id, CASE WHEN action = 'AUTO_HANDLE' AND reasons = '' THEN 'no_reason' WHEN action = 'ESCALATE' THEN 'escalated_with_reply' ELSE '' END AS errors FROM dec")
def m17_invariants(spark, d):
    bad = P.invariant_errors(F.col("action"), F.lit("hello"), F.col("reasons"), F.lit(3), F.col("decision_confidence"))
    return _decided(spark, d).select("conv_id", F.array_join(bad, ",").alias("errors"))


@query("""WITH s AS (SELECT doc_id, n_chars % 5 + 1 AS a, doc_id % 5 + 1 AS b FROM documents) SELECT 'tone' AS dimension, round(avg(a), 9) AS mean, round(avg((a >= 4)::INTEGER), 9) AS share_4, count(*) FILTER (a = 1) AS n_1, count(*) FILTER (a = 2) AS n_2, count(*) FILTER (a = 3) AS n_3, count(*) FILTER (a = 4) AS n_4, count(*) FILTER (a = 5) AS n_5 FROM s
UNION ALL SELECT 'truth', round(avg(b), 9), round(avg((b >= 4)::INTEGER), 9), count(*) FILTER (b = 1), count(*) FILTER (b = 2), count(*) FILTER (b = 3), count(*) FILTER (b = 4), count(*) FILTER (b = 5) FROM s""")
def a15_judge_summary(spark, d):
    s = read(spark, d, "documents").select((F.col("n_chars") % 5 + 1).alias("tone"), (F.col("doc_id") % 5 + 1).alias("truth"))
    r = RV.judge_summary(s, ["tone", "truth"])
    return r.withColumns({"mean": F.round("mean", 9), "share_4": F.round("share_4", 9)})


@query("""WITH l AS (SELECT event_type AS candidate, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS gold FROM events), m AS (SELECT candidate, gold, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY candidate) AS total FROM m WHERE true)
SELECT least(candidate, gold) || '|' || greatest(candidate, gold) AS pair, count(*) AS ways, sum(n)::BIGINT AS n, round(max(n / total), 9) AS rate FROM t WHERE candidate <> gold GROUP BY 1""")
def a18_swapped_labels(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").select(F.col("event_type").alias("candidate"), F.when(F.col("event_id") % 3 == 0, "click").otherwise(F.col("event_type")).alias("gold"))
    m = e.groupBy("candidate", "gold").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("candidate"))).where("candidate <> gold")
    return m.groupBy(V.pair_key(F.col("candidate"), F.col("gold")).alias("pair")).agg(F.count("*").alias("ways"), F.sum("n").alias("n"), F.round(F.max("share"), 9).alias("rate"))


@query("""WITH l AS (SELECT event_type AS c, CASE WHEN event_id % 3 <> 0 THEN event_type WHEN event_type = 'click' THEN 'view' ELSE 'click' END AS h FROM events), m AS (SELECT c, h, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY c) AS share FROM m)
SELECT least(c, h) || '|' || greatest(c, h) AS pair, sum(n)::BIGINT AS n, round(max(share), 9) AS rate FROM s WHERE c <> h GROUP BY 1 HAVING count(*) = 2 AND max(share) >= 0.3""")
def a18_merge_candidates(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("candidate"), F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_type") == "click", "view").otherwise("click")).otherwise(F.col("event_type")).alias("human"))
    return RV.merge_candidates(e, "candidate", "human").withColumn("rate", F.round("rate", 9))


@query("""WITH l AS (SELECT event_type AS candidate, CASE WHEN event_id % 10 < 6 AND event_type = 'view' THEN 'NEW:browse' WHEN event_type = 'error' THEN 'click' ELSE event_type END AS gold FROM events), m AS (SELECT candidate, gold, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY candidate) AS total, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, gold) AS k FROM m)
SELECT 'rename' AS signal, candidate || '->' || gold AS subject, n FROM t WHERE k = 1 AND candidate <> gold AND n / total >= 0.5 UNION ALL SELECT 'unused', candidate, 0 FROM (SELECT DISTINCT candidate FROM m) WHERE candidate NOT IN (SELECT gold FROM m) UNION ALL SELECT 'add', gold, sum(n)::BIGINT FROM m WHERE gold LIKE 'NEW:%' GROUP BY gold HAVING sum(n) >= 3""")
def a19_review_signals(spark, d):
    gold = F.when((F.col("event_id") % 10 < 6) & (F.col("event_type") == "view"), "NEW:browse").when(F.col("event_type") == "error", "click").otherwise(F.col("event_type"))
    return RV.review_signals(read(spark, d, "events").select(F.col("event_type").alias("candidate"), gold.alias("gold")), "candidate", "gold")


@query(f"WITH l AS ({_LABELS}) SELECT count(*) AS n, round(count(*) FILTER (predicted = 0 AND gold = 0) / nullif(count(*) FILTER (predicted = 0), 0), 9) AS precision, round(count(*) FILTER (predicted = 0 AND gold = 0) / nullif(count(*) FILTER (gold = 0), 0), 9) AS recall FROM l")
def a18_fallback_quality(spark, d):
    r = RV.fallback_quality(_labels(spark, d).select(F.col("predicted").cast("string").alias("c"), F.col("gold").cast("string").alias("h")), "c", "h", "0")
    return r.select("n", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH l AS ({_LABELS}) SELECT round(sum(CASE WHEN gold = predicted THEN doc_id % 7 + 1 ELSE 0 END) / sum(doc_id % 7 + 1), 9) AS agreement, sum(doc_id % 7 + 1)::BIGINT AS weight FROM l")
def a17_weighted_agreement(spark, d):
    r = RV.weighted_agreement(_labels(spark, d).withColumn("w", F.col("doc_id") % 7 + 1), "gold", "predicted", "w")
    return r.select(F.round("agreement", 9).alias("agreement"), "weight")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS p FROM documents) WHERE p = 1 ORDER BY sha256(doc_id::VARCHAR) LIMIT 6")
def u12_examples(spark, d):
    return RV.one_per_group(read(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query("""WITH d AS (SELECT doc_id, lang, n_chars / 1000.0::DOUBLE AS margin FROM documents), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), x AS (SELECT lang, n, 60.0 * n / sum(n) OVER () AS x FROM c), b AS (SELECT *, least(n, greatest(1, floor(x)::BIGINT)) AS q FROM x),
l AS (SELECT *, 60 - sum(q) OVER () AS left_, row_number() OVER (ORDER BY CASE WHEN n > q THEN x - q END DESC NULLS LAST, lang) AS place FROM b), q AS (SELECT lang, n AS eligible, q + CASE WHEN place <= left_ AND n > q THEN 1 ELSE 0 END AS quota FROM l), t AS (SELECT lang, quantile_cont(margin, 0.4) AS cut FROM d GROUP BY lang),
r AS (SELECT d.*, q.quota, q.eligible, margin <= cut AS hard, sha256('42:' || doc_id) AS h FROM d JOIN q USING (lang) JOIN t USING (lang)), f AS (SELECT *, hard AND row_number() OVER (PARTITION BY lang, hard ORDER BY h) <= ceil(quota / 2) AS first_ FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_ DESC, h) AS place FROM f) SELECT doc_id, lang, CASE WHEN first_ THEN 'low_margin' ELSE 'diverse' END AS reason, round(eligible / least(quota, eligible), 9) AS weight FROM p WHERE place <= quota""")
def u9_calibration_sample(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / 1000.0).alias("margin"))
    return RV.calibration_sample(docs, "doc_id", "lang", "margin", 60).select("doc_id", "lang", "reason", F.round("weight", 9).alias("weight"))


@query("""WITH s AS (SELECT doc_id, n_chars FROM documents), a AS (SELECT doc_id FROM s ORDER BY n_chars DESC, sha256('42:' || doc_id) LIMIT 1), b AS (SELECT doc_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a) AND 1000000 - n_chars > 0 ORDER BY 1000000 - n_chars DESC, sha256('42:' || doc_id) LIMIT 1)
SELECT 'longest' AS scenario, doc_id FROM a UNION ALL SELECT 'shortest', doc_id FROM b""")
def u13_scenarios(spark, d):
    return RV.scenario_picks(read(spark, d, "documents"), "doc_id", {"longest": F.col("n_chars"), "shortest": 1_000_000 - F.col("n_chars")})


@query(f"""SELECT 'doc' AS kind, count(*) FILTER (c >= 0.75) AS sure, round(avg(c), 6) AS mean FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN (doc_id % 101) / 100.0 WHEN doc_id % 4 = 1 AND doc_id % 101 > 1 THEN (doc_id % 101) / 100.0 WHEN doc_id % 4 = 1 THEN (doc_id % 101)::DOUBLE WHEN doc_id % 4 = 2 THEN (doc_id % 101) / 101.0 END AS c FROM documents)""")
def f10_confidences(spark, d):
    k = F.col("doc_id") % 101
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(k.cast("string"), F.lit("%"))).when(F.col("doc_id") % 4 == 1, k.cast("string")).when(F.col("doc_id") % 4 == 2, (k / 101.0).cast("string")).otherwise("sure")
    return read(spark, d, "documents").select(V.confidence(said).alias("c")).agg(F.lit("doc").alias("kind"), F.count_if(F.col("c") >= 0.75).alias("sure"), F.round(F.avg("c"), 6).alias("mean"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'refunds' WHEN doc_id % 3 = 1 THEN 'unclear_or_media_only' ELSE 'account_access' END AS intent, CASE WHEN doc_id % 3 = 1 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN doc_id % 3 <> 0 THEN 'refunds' END AS alternative FROM documents""")
def f16_classifications(spark, d):
    c = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, ' "Refunds" ').when(F.col("doc_id") % 3 == 1, "Weather").otherwise("Account-Access").alias("intent"), F.lit("80%").alias("confidence"), F.lit("refunds").alias("alternative"))
    known = spark.createDataFrame([("refunds",), ("account_access",)], "intent string")
    return RV.normalised_classification(c, known)


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'intent_missing' END, CASE WHEN doc_id % 4 = 1 THEN 'intent_unknown' END, CASE WHEN doc_id % 3 = 0 THEN 'resolution_unknown' END, CASE WHEN doc_id % 5 = 0 THEN 'escalate_not_yes_or_no' END], lambda x: x IS NOT NULL), ',') AS errors,
CASE WHEN doc_id % 4 = 0 THEN 'partial' ELSE 'labelled' END AS status FROM documents""")
def r4_label_errors(spark, d):
    i = F.col("doc_id")
    intent = F.when(i % 4 == 0, " ").when(i % 4 == 1, "Nope").when(i % 4 == 2, "NEW:good_one").otherwise("refunds")
    kind, esc = F.when(i % 3 == 0, "x").otherwise("refund"), F.when(i % 5 == 0, "maybe").otherwise("yes")
    return read(spark, d, "documents").select("doc_id", F.array_join(L.label_errors(intent, kind, esc, ["refunds"], ["refund"]), ",").alias("errors"), L.case_status(intent, kind, esc).alias("status"))


@query()
def m4_kmeans(spark, d):
    """Every k from 8 to 15, two seeds, ten starts each: 160 models in the same scans."""
    rows = MD.swept(read(spark, d, "embeddings"), "vec_id", "embedding", starts=10)
    best = ML.chosen_k(rows)
    return spark.createDataFrame([(r["k"], r["silhouette"], r["inertia"], r["seed_ari"], r["min_share"], r["k"] == best) for r in rows], "k int, silhouette double, inertia double, seed_ari double, min_share double, chosen boolean")


@query()
def m3_lsa(spark, d):
    """Term counts of the benchmark items reduced to 8 directions; the vocabulary is as large as the data needs."""
    from pyspark.ml.feature import CountVectorizer

    items = read(spark, d, "benchmark").select("item_id", X.tokens(F.col("text")).alias("terms"))
    size = ML.vocabulary_size(items, "terms")
    weighed = CountVectorizer(inputCol="terms", outputCol="weights", minDF=2, vocabSize=size).fit(items).transform(items)
    from pyspark.ml.functions import vector_to_array

    return ML.lsa(weighed, 8).select("item_id", F.posexplode(vector_to_array("features")).alias("i", "x"))


@query()
def m7_tfidf_classifier(spark, d):
    """Languages of a quarter of all documents, by the best C of the grid on another quarter, fitted on the other half."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    terms = X.tokens(F.col("text"))
    model = MD.tuned(docs.where("doc_id % 4 in (1, 2)"), docs.where("doc_id % 4 = 3"), terms, "lang", width=1 << 14)
    return model.predicted(docs.where("doc_id % 4 = 0"), terms, "doc_id", "lang").withColumn("c", F.lit(model.c))


@query(f"SELECT doc_id, round({_U12(chr(39) + '42:' + chr(39) + ' || doc_id')}, 12) AS score FROM documents")
def f15_hash_scores(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(V.hash_fraction(V.seeded(42, F.col("doc_id"))), 12).alias("score"))


@query(rf"""WITH {TURNS}, k AS (SELECT author_id, text, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace({_NORM.format(x='text')}, '\d+', '0', 'g'), '[^a-z0-9<>'' ]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> '')[1:6], ' ') AS template FROM turns WHERE NOT inbound),
w AS (SELECT author_id, template, text, count(*) AS k FROM k GROUP BY ALL), p AS (SELECT author_id, template, sum(k)::BIGINT AS n, min_by(text, (-k, text)) AS example FROM w GROUP BY ALL HAVING sum(k) >= 3) SELECT author_id, template, n, example FROM p QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY n DESC, template) <= 5""")
def a9_reply_patterns(spark, d):
    return TX.reply_patterns(turns(spark, d).where(~F.col("inbound")), "author_id", "text").select("author_id", "template", "n", "example")


@query("""SELECT label, count(*) AS n, round(avg(m), 4) AS mean_margin, round(quantile_cont(m, 0.25), 6) AS low_margin FROM (SELECT label, (vec_id * 37 % 100) / 100.0::DOUBLE AS m FROM embeddings) GROUP BY label""")
def a8_cluster_report(spark, d):
    e = read(spark, d, "embeddings").select("label", ((F.col("vec_id") * 37 % 100) / 100.0).alias("m"), (F.col("vec_id") % 4).alias("second"), (F.col("vec_id") % 3).alias("kind"))
    return TX.cluster_report(e, "label", "m", "second", "kind").select("label", "n", "mean_margin", F.round("low_margin", 6).alias("low_margin"))


@query("""WITH c AS (SELECT source AS cluster, lang AS intent, count(*) AS size FROM documents GROUP BY ALL), x AS (SELECT a.cluster, a.intent, b.intent AS other, b.size / sum(b.size) OVER (PARTITION BY a.cluster, a.intent) AS share, a.size FROM c a JOIN c b ON a.cluster = b.cluster AND a.intent <> b.intent)
SELECT intent, other, round(sum(share * size) / (SELECT sum(size) FROM (SELECT DISTINCT intent, cluster, size FROM x) y WHERE y.intent = x.intent), 6) AS weight FROM x GROUP BY intent, other""")
def a29_confusable(spark, d):
    c = read(spark, d, "documents").groupBy(F.col("source").alias("cluster"), F.col("lang").alias("intent")).agg(F.count("*").alias("size"))
    pairs = c.join(c.select("cluster", F.col("intent").alias("other"), F.col("size").alias("other_size")), "cluster").where("intent <> other")
    n = pairs.withColumn("share", F.col("other_size") / F.sum("other_size").over(Window.partitionBy("cluster", "intent")))
    return TX.known_confusable(n).select("intent", "other", "weight")


@query("SELECT doc_id, round(cume_dist() OVER (PARTITION BY lang ORDER BY n_chars), 9) AS percentile FROM documents")
def w17_margin_percentiles(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(TX.margin_percentile("n_chars", "lang"), 9).alias("percentile"))


@query("SELECT lang, count(*) FILTER (l.doc_id IS NULL) AS to_score, count(l.quality) AS cached FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def j16_cached_predictions(spark, d):
    docs = read(spark, d, "documents").select("lang", TX.request_key(F.col("doc_id"), F.lit("model")).alias("key"))
    cache = read(spark, d, "labels").select(TX.request_key(F.col("doc_id"), F.lit("model")).alias("key"), "quality")
    return TX.with_cached(docs, cache, ["key"]).groupBy("lang").agg(F.count_if("to_score").alias("to_score"), F.count("quality").alias("cached"))


@query()
def s17_hashed_vectors(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(TX.hashed_vector(X.tokens(F.col("text")))).alias("i", "x"))


@query()
def m16_handled_messages(spark, d):
    memory = graph.saved(_memory(spark, d).where("historical_response <> ''"))
    t = turns(spark, d).where("turn = 0")
    m = t.select(F.col("conv_id").cast("string").alias("case_id"), F.col("text").alias("message"), F.element_at(F.array(F.lit("refunds"), F.lit("access")), (F.col("conv_id") % 2 + 1).cast("int")).alias("intent"), F.lit(0.9).alias("confidence"), F.lit(False).alias("multi_intent"), F.when(F.col("conv_id") % 9 == 0, "timeout").alias("error"))
    drafts = m.select("case_id", F.lit("Please see https://example.com/new for £9.99").alias("reply"))
    return AG.handled(m, memory, drafts).select("case_id", "action", F.array_join("reasons", ",").alias("reasons"), "reply")


# ---- labels matched and decided ----

_TOP = """t AS (SELECT source, doc_id % 2 AS half, term, count(*) AS n FROM (SELECT source, doc_id, unnest({tokens}) AS term FROM documents) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, half ORDER BY n DESC, term) AS k FROM t),
p AS (SELECT a.source AS cluster, b.source AS label, count(*) / 8 AS score FROM r a JOIN r b ON a.term = b.term AND a.half = 0 AND b.half = 1 AND a.k <= 12 AND b.k <= 8 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_TOP.replace('{tokens}', _TOKENS)}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, cluster DESC, label DESC) AS k FROM p WHERE score >= 0.35),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS cs, []::VARCHAR[] AS ls, false AS took UNION ALL SELECT o.k, CASE WHEN list_contains(cs, cluster) OR list_contains(ls, label) THEN cs ELSE list_append(cs, cluster) END, CASE WHEN list_contains(cs, cluster) OR list_contains(ls, label) THEN ls ELSE list_append(ls, label) END, NOT (list_contains(cs, cluster) OR list_contains(ls, label)) FROM g JOIN o ON o.k = g.k + 1)
SELECT cluster, label, score FROM o JOIN g USING (k) WHERE took""")
def j15_matched_labels(spark, d):
    """Sources matched one to one: the top 12 terms of their documents with even ids, as clusters, with the top 8 of those with odd ids, as anchors."""
    docs = read(spark, d, "documents").select("source", (F.col("doc_id") % 2).alias("half"), F.explode(X.tokens(F.col("text"))).alias("term"))
    n = docs.groupBy("source", "half", "term").agg(F.count("*").alias("n"))
    top = graph.saved(n.withColumn("k", F.row_number().over(Window.partitionBy("source", "half").orderBy(F.desc("n"), "term"))).where("k <= 12"))
    terms, anchors = top.where("half = 0").select(F.col("source").alias("cluster"), "term"), top.where("half = 1 and k <= 8").select(F.col("source").alias("label"), F.col("term").alias("anchor"))
    return L.matched_labels(L.anchor_scores(terms, anchors))


#: Decisions on event types; order matters: what becomes "click" at the end is not moved by the first one.
DECISIONS = [
    {"action": "merge", "from": ["click", "view"], "to": "browse"}, {"action": "rename", "from": ["browse"], "to": "interest"}, {"action": "drop", "from": ["error"]},
    {"action": "merge", "from": ["interest", "signup"], "to": "interest"}, {"action": "new", "to": "unused"}, {"action": "rename", "from": ["purchase"], "to": "click"},
]
_STEPS = ", ".join(f"({i}, '{x}', '{d.get('to') or 'other'}')" for i, d in enumerate(DECISIONS) for x in d.get("from", []))
_DECIDED = f"""steps AS (SELECT * FROM (VALUES {_STEPS}) s(step, source, target)), walk AS (SELECT DISTINCT event_type AS label, event_type AS now, -1 AS step FROM events UNION ALL SELECT label, s.target, s.step FROM walk JOIN steps s ON s.source = now AND s.step = (SELECT min(step) FROM steps n WHERE n.source = walk.now AND n.step > walk.step)),
m AS (SELECT label, arg_max(now, step) AS final FROM walk GROUP BY label)"""


def _label_map(spark, d):
    events = read(spark, d, "events").select(F.col("event_type").alias("label"))
    return L.label_map(events, L.decision_steps(spark, DECISIONS, "other"))


@query(f"WITH RECURSIVE {_DECIDED} SELECT label, final, count(*) AS n FROM events JOIN m ON label = event_type GROUP BY label, final")
def r1_decided_labels(spark, d):
    events = read(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return events.join(_label_map(spark, d), "label").select("label", "final", "n")


@query(f"""WITH RECURSIVE {_DECIDED}, c AS (SELECT event_type AS label, 'k' || user_id % 9 AS kind, count(*) AS k FROM events GROUP BY ALL), s AS (SELECT label, sum(k) OVER (PARTITION BY label) AS n, kind, k / sum(k) OVER (PARTITION BY label) AS share FROM c),
t AS (SELECT final, sum(n) AS n FROM (SELECT DISTINCT final, label, n FROM s JOIN m USING (label)) GROUP BY final), w AS (SELECT final, kind, sum(share * n) AS w FROM s JOIN m USING (label) GROUP BY ALL), r AS (SELECT final, n::BIGINT AS n, kind, round_even((w / n)::DOUBLE, 3) AS share FROM w JOIN t USING (final))
SELECT *, row_number() OVER (PARTITION BY final ORDER BY share DESC, kind)::INTEGER AS place FROM r QUALIFY place <= 6""")
def a26_merged_shares(spark, d):
    c = read(spark, d, "events").groupBy(F.col("event_type").alias("label"), F.concat(F.lit("k"), (F.col("user_id") % 9).cast("string")).alias("kind")).agg(F.count("*").alias("k"))
    n = F.sum("k").over(Window.partitionBy("label"))  # a row a kind
    return L.merged_shares(c.select("label", n.alias("n"), "kind", (F.col("k") / n).alias("share")), _label_map(spark, d))
