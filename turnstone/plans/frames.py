"""Queries over composed brands, profiles, and the tables of evaluation, labelling and agent runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.operators import brand as BR
from turnstone.operators import episodes as E
from turnstone.operators import frames as FR
from turnstone.operators import graph
from turnstone.operators import labels as L
from turnstone.operators import profile as PR
from turnstone.operators import threads as TH
from turnstone.plans.bindings import TURNS, messages, read, threads, turns
from turnstone.plans.messages import _EPISODES
from turnstone.plans.scores import _SPLIT, _TOKENS, _decided, _DECIDE

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_OPENER = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '\d+', '0', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_TIMED = "ts IS NULL, ts, depth, tweet_id"

# ---- a brand ----

# Threads of the brand are those it wrote in; a thread without any outbound message does not name it.
_BRAND = f"""{_EPISODES}, ours AS (SELECT DISTINCT conv_id FROM turns WHERE author_id = 'acme'), root AS (SELECT conv_id, min_by(tweet_id, (CASE WHEN ts IS NULL THEN 1 ELSE 0 END, coalesce(ts, 0), tweet_id)) AS root FROM turns GROUP BY conv_id)"""


@query(f"""WITH {_BRAND} SELECT 'case_' || m.head AS case_id, 'conv_' || any_value(root) AS conversation_id, any_value(m.owner_id) AS customer_id, count(*) AS turn_count, count(*) FILTER (role = 'brand_agent') AS agent_turn_count, any_value(h.prev) IS NOT NULL AS is_continuation, string_agg(m.tweet_id::VARCHAR, ',' ORDER BY m.tweet_id) AS messages
FROM mem m JOIN ours USING (conv_id) JOIN root USING (conv_id) JOIN heads h ON h.head = m.head GROUP BY m.head""")
def s19_brand_cases(spark, d):
    c = BR.built(messages(spark, d).drop("role", "conv_id"), "acme", keep=False).cases
    return c.select("case_id", "conversation_id", "customer_id", "turn_count", "agent_turn_count", "is_continuation", F.array_join(F.transform("source_tweet_ids", lambda x: x.cast("string")), ",").alias("messages"))


@query(f"""WITH {_BRAND}, g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts IS NULL, ts, tweet_id)) / 3600.0 AS gap FROM turns),
c AS (SELECT conv_id, string_agg(author_id, ',' ORDER BY late, ts, tweet_id) AS customers FROM (SELECT conv_id, author_id, min_by(ts, (CASE WHEN ts IS NULL THEN 1 ELSE 0 END, coalesce(ts, 0), tweet_id)) AS ts, min((CASE WHEN ts IS NULL THEN 1 ELSE 0 END)) AS late, min_by(tweet_id, (CASE WHEN ts IS NULL THEN 1 ELSE 0 END, coalesce(ts, 0), tweet_id)) AS tweet_id FROM turns WHERE role = 'customer' GROUP BY ALL) GROUP BY conv_id),
k AS (SELECT conv_id, count(DISTINCT head) AS n FROM mem GROUP BY conv_id)
SELECT 'conv_' || any_value(root) AS conversation_id, count(*) AS tweet_count, round(max(gap), 6) AS max_gap_hours, coalesce(any_value(customers), '') AS customers, coalesce(any_value(k.n), 0)::BIGINT AS cases FROM g JOIN ours USING (conv_id) JOIN root USING (conv_id) LEFT JOIN c USING (conv_id) LEFT JOIN k USING (conv_id) GROUP BY conv_id""")
def a4_conversations(spark, d):
    c = BR.built(messages(spark, d).drop("role", "conv_id"), "acme", keep=False).conversations
    return c.select("conversation_id", "tweet_count", F.round("max_gap_hours", 6).alias("max_gap_hours"), F.array_join("customer_ids", ",").alias("customers"), F.size("case_ids").cast("long").alias("cases"))


@query(f"""WITH {_EPISODES}, w AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY {_TIMED}) AS k FROM mem),
c AS (SELECT head, bool_or(role = 'brand_agent') AS answered, min_by(role, k) = 'customer' AS opens, min_by(text, CASE WHEN role = 'customer' THEN k END) AS opening FROM w GROUP BY head)
SELECT 'case_' || c.head AS case_id, answered AND opens AND h.prev IS NULL AND len(list_filter(string_split({_OPENER.format(x="coalesce(opening, '')")}, ' '), lambda t: t <> '')) >= 3 AS eligible FROM c JOIN heads h ON h.head = c.head""")
def p5_golden_eligible(spark, d):
    rows = graph.saved(E.segmented(threads(spark, d)))
    follows = rows.where("case_id is not null").groupBy("case_id").agg(F.bool_or(F.col("continues_case_id").isNotNull()).alias("is_continuation"))
    c = E.case_table(rows).join(follows, "case_id")
    return c.select("case_id", FR.golden_eligible(F.col("opening_message"), F.col("has_brand_reply"), F.col("is_continuation"), F.col("starts_with_customer")).alias("eligible"))


# ---- profiles ----


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, count(*) AS n, bool_or(inbound) AND bool_or(NOT inbound) AS both_ FROM turns GROUP BY conv_id),
m AS (SELECT count(*) AS total_tweets, count(DISTINCT author_id) AS unique_authors, count(DISTINCT author_id) FILTER (NOT inbound) AS unique_brands, count(*) FILTER (inbound) AS inbound_tweets, count(*) FILTER (NOT inbound) AS outbound_tweets, round(count(*) FILTER (inbound) / greatest(1, count(*) FILTER (NOT inbound)), 4) AS inbound_outbound_ratio, min(ts) AS first_second, max(ts) AS last_second,
 round(100.0 * avg((turn > 0 AND turn % 2 = 0)::INTEGER), 2) AS pct_with_in_response_to, round(100.0 * avg((turn % 2 = 0)::INTEGER), 2) AS pct_with_response_tweet_id, round(100.0 * avg((turn % 2 = 0)::INTEGER), 2) AS pct_with_any_relationship, 0.0 AS pct_with_multiple_responses FROM turns),
c AS (SELECT count(*) AS count, count(*) FILTER (n = 1) AS single_tweet, round(100.0 * avg((n = 1)::INTEGER), 2) AS pct_single_tweet, count(*) FILTER (both_) AS with_customer_and_brand, round(avg(n), 3) AS size_mean, quantile_cont(n, 0.5) AS size_median, quantile_cont(n, 0.9) AS size_p90, quantile_cont(n, 0.99) AS size_p99, max(n) AS size_max FROM s)
SELECT CASE WHEN name LIKE 'pct%' THEN 'relationships' ELSE 'messages' END AS section, name, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM m) ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'conversations', name, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM c) ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'sizes', least(n, 10)::VARCHAR, count(*)::DOUBLE FROM s GROUP BY 2 UNION ALL SELECT 'brand', author_id, count(*)::DOUBLE FROM turns WHERE NOT inbound GROUP BY author_id""")
def s8_dataset_profile(spark, d):
    m = graph.saved(messages(spark, d))
    return PR.dataset_profile(m, TH.reconstructed(m))


@query(f"""WITH {_EPISODES}, c AS (SELECT head, count(*) AS n, min(ts) AS t FROM mem GROUP BY head), x AS (SELECT 'length' AS section, CASE WHEN n <= 2 THEN 'short_1-2' WHEN n <= 4 THEN 'medium_3-4' WHEN n <= 8 THEN 'long_5-8' ELSE 'very_long_9+' END AS name FROM c
UNION ALL SELECT 'week', CASE WHEN t IS NULL THEN 'unknown_time' ELSE 'week_' || strftime(date_trunc('week', make_timestamp(t::BIGINT * 1000000)), '%Y-%m-%d') END FROM c)
SELECT section, name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY section), 9) AS share FROM x GROUP BY section, name""")
def a25_case_report(spark, d):
    c = E.case_table(graph.saved(E.segmented(threads(spark, d))))
    return PR.case_report(c).where("section in ('week', 'length')").withColumn("share", F.round("share", 9))


# ---- retrieval ----


@query(f"SELECT doc_id, lang AS intent FROM documents WHERE n_chars % 3 = 0 AND lang <> 'es' AND len({_TOKENS}) >= 1")
def p7_retrieval_queries(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "strong").otherwise("weak").alias("evidence_quality"), F.col("lang").alias("intent"), F.col("text").alias("customer_problem"))
    return FR.retrieval_queries(docs, fallback="es").select("doc_id", "intent")


_PAIRED = f"p AS (SELECT a.item_id, a.qt, b.dt, a.item_id % 3 AS qi, a.item_id % 2 AS qr, b.doc_id % 3 AS di, b.doc_id % 4 AS dr FROM (SELECT item_id, {_TOKENS} AS qt FROM benchmark) a JOIN (SELECT doc_id, {_TOKENS} AS dt FROM documents) b ON b.doc_id % 200 = a.item_id)"


@query(f"""WITH {_PAIRED}, s AS (SELECT *, list_sort(list_distinct(list_filter(qt, lambda t: list_contains(dt, t)))) AS shared FROM p), r AS (SELECT qi = di AND qr = dr AS relevant, array_to_string(list_filter([
 CASE WHEN qi = di THEN 'same candidate intent (' || di || ')' ELSE 'different candidate intent (' || di || ' vs query ' || qi || ')' END, CASE WHEN qr = dr THEN 'same resolution type (' || dr || ')' ELSE 'different resolution type (' || dr || ' vs query''s ' || qr || ')' END,
 CASE WHEN len(shared) > 0 THEN 'shared terms: ' || array_to_string(shared[1:8], ', ') END], lambda x: x IS NOT NULL), '; ') AS reasons FROM s) SELECT relevant, sha256(reasons) AS reasons, count(*) AS n FROM r GROUP BY ALL""")
def m13_match_reasons(spark, d):
    a = read(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), (F.col("item_id") % 3).cast("string").alias("q_intent"), (F.col("item_id") % 2).cast("string").alias("q_resolution"))
    b = read(spark, d, "documents").select((F.col("doc_id") % 200).alias("item_id"), F.col("text").alias("document"), (F.col("doc_id") % 3).cast("string").alias("d_intent"), (F.col("doc_id") % 4).cast("string").alias("d_resolution"))
    r = FR.match_reasons(a.join(b, "item_id")).select("relevant", F.sha2(F.array_join("reasons", "; "), 256).alias("reasons"))
    return r.groupBy("relevant", "reasons").agg(F.count("*").alias("n"))


# ---- labels ----

_PACK = "p AS (SELECT d.doc_id, d.n_chars, CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN ' good ' ELSE 'poor' END AS gold, CASE d.doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'draft' WHEN 2 THEN 'confirmed' END AS who, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _pack(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left")
    gold = F.when(F.col("quality") == 1, " good ").when(F.col("quality").isNotNull(), "poor").otherwise("")
    pack = rows.select(F.col("doc_id").alias("case_id"), F.col("n_chars").alias("labeling_order"), F.col("lang").alias("first_customer_message"), gold.alias("gold_intent"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("gold_should_escalate"), F.lit("other").alias("gold_resolution_type"))
    who = docs.select(F.col("doc_id").alias("case_id"), F.element_at(F.array(F.lit("human"), F.lit("draft"), F.lit("confirmed"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")).alias("provenance"))
    return pack, who


@query(f"WITH {_PACK} SELECT doc_id AS case_id, n_chars::INTEGER AS labeling_order, trim(gold) AS gold_intent, coalesce(who, '') AS provenance, coalesce(who, '') = 'human' AND gold <> '' AS blind_human, coalesce(who, '') IN ('human', 'confirmed', 'corrected') AND gold <> '' AS all_reviewed, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS gold_should_escalate FROM p")
def r8_golden_frames(spark, d):
    return FR.golden_agent(*_pack(spark, d)).select("case_id", "labeling_order", "gold_intent", "provenance", "blind_human", "all_reviewed", "gold_should_escalate")


@query(f"WITH {_SPLIT} SELECT r.doc_id AS case_id, 'dev' AS split, 'intent_' || (d.n_chars % 5) AS label FROM r JOIN documents d USING (doc_id) WHERE reason = '' AND split = 'dev' AND d.n_chars % 5 <> 3 AND trim(d.lang) <> ''")
def r8_weak_labels(spark, d):
    from turnstone.plans.scores import _assigned

    cases = read(spark, d, "documents").select(F.col("doc_id").alias("case_id"), (F.col("n_chars") % 5).alias("cluster_id"), F.col("lang").alias("opening_message"))
    intents = cases.select("cluster_id").distinct().select("cluster_id", F.when(F.col("cluster_id") != 3, F.concat(F.lit("intent_"), F.col("cluster_id").cast("string"))).alias("intent"))
    return FR.weak_labels(cases, intents, graph.saved(_assigned(spark, d)[1]), "dev").select("case_id", "split", "label")


@query(f"""WITH {TURNS}, t AS (SELECT conv_id, string_agg('[' || upper(role) || ' ' || tweet_id || '] ' || text, chr(10) ORDER BY ts IS NULL, ts, tweet_id) AS conversation, min(tweet_id) AS a, count(*) AS n FROM turns GROUP BY conv_id)
SELECT conv_id AS case_id, 'opening ' || conv_id AS first_customer_message, conversation, '[' || a || ']' AS source_tweet_ids, round(n / 7, 4) AS margin, '' AS human_intent, '' AS human_notes FROM t""")
def r17_calibration_sheet(spark, d):
    t = E.turns_of(turns(spark, d), "conv_id")
    ids = F.transform("turns", lambda x: x["tweet_id"])
    sample = t.select(F.col("conv_id").alias("case_id"), F.concat(F.lit("opening "), F.col("conv_id").cast("string")).alias("opening_message"), "turns", F.array(F.array_min(ids)).alias("source_tweet_ids"), (F.size("turns") / 7).alias("margin"))
    return FR.calibration_sheet(sample).select("case_id", "first_customer_message", "conversation", "source_tweet_ids", "margin", "human_intent", "human_notes")


@query("WITH e AS (SELECT user_id AS case_id, event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')), s AS (SELECT case_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS cleared FROM e GROUP BY case_id), l AS (SELECT e.case_id, max_by(e.event_type, e.event_id) AS value, count(*) AS saves FROM e JOIN s USING (case_id) WHERE e.event_type <> 'purchase' AND (cleared IS NULL OR e.event_id > cleared) GROUP BY e.case_id) SELECT case_id, value, saves, CASE WHEN saves = 1 THEN 'human' ELSE 'corrected' END AS provenance FROM l")
def r6_label_state(spark, d):
    """The log folded in two parts, as a label store keeps it."""
    e = read(spark, d, "events").where("event_type in ('click', 'view', 'purchase')").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "clear").otherwise("save").alias("action"), F.col("event_type").alias("value"))
    half = e.agg(F.avg("seq")).first()[0] or 0
    none = spark.createDataFrame([], f"case_id {dict(e.dtypes)['case_id']}, value string, saves long, drafted string, seq {dict(e.dtypes)['seq']}")
    return L.standing(L.folded(graph.saved(L.folded(none, e.where(F.col("seq") <= half))), e.where(F.col("seq") > half)))


# ---- agent runs ----


@query(f"""WITH {_DECIDE}, stages AS (SELECT conv_id, action, CASE WHEN conv_id % 11 = 0 THEN 'error' WHEN conv_id % 11 = 1 THEN 'declined' WHEN action = 'AUTO_HANDLE' THEN 'produced' ELSE 'not_attempted' END AS generation, CASE WHEN conv_id % 3 = 0 THEN 'not_run' WHEN conv_id % 13 = 0 THEN 'unavailable' WHEN conv_id % 3 = 1 THEN 'pass' ELSE 'fail' END AS grounding FROM dec)
SELECT conv_id, CASE WHEN generation <> 'not_attempted' THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS policy_action, generation, grounding, conv_id % 17 = 0 AS classification_failed FROM stages""")
def r15_stage_outcomes(spark, d):
    c = F.col("conv_id")
    r = _decided(spark, d)
    said = F.concat("reasons", F.array_compact(F.array(F.when(c % 11 == 0, F.lit("reply generation failed: timeout")), F.when(c % 11 == 1, F.lit("the generator returned no reply")), F.when(c % 17 == 0, F.lit("classification failed: x")))))
    claims = F.when(c % 13 == 0, F.array(F.lit("could not verify"))).otherwise(F.array(F.lit("a claim")))
    stages = FR.stage_outcomes(said, F.when(F.col("action") == "AUTO_HANDLE", "reply"), F.lit(None).cast("string"), F.when(c % 3 != 0, c % 3 == 1), claims)
    return r.select("conv_id", *[v.alias(k) for k, v in stages.items()])


@query(f"""WITH {_SPLIT}, a AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, r.k, CASE WHEN reason <> '' THEN 'excluded' ELSE split END AS split FROM r JOIN documents d USING (doc_id)), g AS (SELECT * FROM a WHERE split = 'golden')
SELECT doc_id AS case_id, array_to_string(list_filter([CASE WHEN split NOT IN ('train', 'dev') THEN 'split_not_allowed' END, CASE WHEN split <> 'train' THEN 'split_differs' END, CASE WHEN n_chars % 50 IN (SELECT n_chars % 50 FROM g) THEN 'customer' END,
 CASE WHEN doc_id // 5 IN (SELECT doc_id // 5 FROM g) THEN 'conversation' END, CASE WHEN doc_id // 3 IN (SELECT doc_id // 3 FROM g) THEN 'group' END, CASE WHEN n_chars % 500 IN (SELECT n_chars % 500 FROM g) THEN 'tweets' END, CASE WHEN k <> '' AND k IN (SELECT k FROM g) THEN 'opening_text' END], lambda x: x IS NOT NULL), ',') AS errors FROM a
WHERE errors <> ''""")
def r16_unsafe_cases(spark, d):
    from turnstone.plans.scores import _assigned

    cases, split = _assigned(spark, d)
    base = cases.select("case_id", (F.col("n_chars") % 50).cast("string").alias("customer_id"), F.expr("(case_id div 5)").cast("string").alias("conversation_id"), F.expr("(case_id div 3)").cast("string").alias("group_id"), F.col("message_ids").alias("tweet_ids"), F.col("start").alias("message"), "opener_key")
    split = graph.saved(split.select("case_id", "split"))
    assigned = base.join(split, "case_id").withColumnsRenamed({"tweet_ids": "source_tweet_ids", "message": "opening_message"}).withColumn("context_tweet_ids", F.array().cast("array<bigint>"))
    return FR.unsafe_cases(base.withColumn("split", F.lit("train")), assigned).select("case_id", F.array_join("errors", ",").alias("errors"))


@query(r"SELECT page_id, length(html) AS n FROM (SELECT page_id, replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS html FROM pages) WHERE NOT regexp_matches(html, '&[A-Za-z#]')")
def t29_unescaped(spark, d):
    p = read(spark, d, "pages").select("page_id", "html", F.replace(F.replace(F.replace("html", F.lit("&copy;"), F.lit("")), F.lit("&middot;"), F.lit("")), F.lit("&amp;"), F.lit("")).alias("rest"))
    return p.where(~F.rlike("rest", F.lit("&[A-Za-z#]"))).select("page_id", F.char_length(X.unescaped(F.col("html"))).cast("long").alias("n"))
