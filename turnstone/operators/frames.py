"""Tables that evaluation, labelling and agent runs start from or leave behind, with the checks they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import labels as L
from turnstone.operators import retrieval as RT
from turnstone.operators.scores import leakage
from turnstone.sources.tables import require_disjoint, require_unique

# ---- fixed values: names and value sets of the label tables ----
GOLD_COLUMNS = ("gold_intent", "gold_should_escalate", "gold_resolution_type", "gold_confidence", "human_notes")
HUMAN_COLUMNS = ("human_intent", "human_resolution_type", "human_resolved", "human_escalation_signal", "human_notes")
JUDGED = ("correctness", "groundedness", "actionability", "brand_alignment")
REVIEWED = ("human", "confirmed", "corrected")


class NotReady(ValueError):
    """A table is not what the next step may use."""


def _none(df: DataFrame, what: str, key: str = "case_id") -> None:
    """Raise NotReady, naming one of the rows, if df has any."""
    bad = df.select(key).limit(1).collect()
    if bad:
        raise NotReady(f"{what}, e.g. {bad[0][0]}")


def _rendered(turns: Column) -> Column:
    return X.render_turns(F.transform(turns, lambda t: F.struct(t["tweet_id"].alias("id"), t["role"].alias("role"), t["text"].alias("text"))))


# ---- choices ----


def golden_eligible(opening: Column, has_brand_reply: Column, is_continuation: Column, starts_with_customer: Column, min_tokens: int = 3) -> Column:
    """Whether a case may be in the golden pool: answered, no continuation, opened by a customer with enough words."""
    words = F.size(F.filter(F.split(X.opener_key(F.coalesce(opening, F.lit(""))), " "), lambda t: t != ""))
    return has_brand_reply & ~is_continuation & starts_with_customer & (words >= min_tokens)


def retrieval_queries(records: DataFrame, fallback: str = RT.FALLBACK) -> DataFrame:
    """Records that can be queries: strong evidence, an intent that is not the fallback, a problem with a term; the problem is named query."""
    usable = (F.col("evidence_quality") == "strong") & F.col("intent").isNotNull() & (F.col("intent") != fallback)
    return records.where(usable & (F.size(X.tokens(F.col("customer_problem"))) >= 1)).withColumnRenamed("customer_problem", "query")


def failure_kind(query: Column, same_intent_in_top: Column) -> Column:
    return F.when(F.size(X.tokens(query)) < 4, "very_short_query").when(~same_intent_in_top, "no_same_intent_in_top5").otherwise("same_intent_but_other_resolution_type")


def match_reasons(pairs: DataFrame, intent_only: bool = False) -> DataFrame:
    """pairs (q_intent, d_intent, q_resolution, d_resolution, query, document) with relevant and reasons."""
    intent, kind = F.col("q_intent") == F.col("d_intent"), F.col("q_resolution") == F.col("d_resolution")
    shared = F.array_sort(F.array_intersect(X.tokens(F.col("query")), X.tokens(F.col("document"))))
    said = lambda what, same, d, q, label: F.when(same, F.concat(F.lit(f"same {what} ("), d, F.lit(")"))).otherwise(F.concat(F.lit(f"different {what} ("), d, F.lit(f" vs {label} "), q, F.lit(")")))
    reasons = F.array_compact(F.array(
        said("candidate intent", intent, F.col("d_intent"), F.col("q_intent"), "query"), said("resolution type", kind, F.col("d_resolution"), F.col("q_resolution"), "query's"),
        F.when(F.size(shared) > 0, F.concat(F.lit("shared terms: "), F.array_join(F.slice(shared, 1, 8), ", "))),
    ))
    return pairs.withColumns({"relevant": F.coalesce(intent & (kind | F.lit(intent_only)), F.lit(False)), "reasons": reasons})


def same_text_rate(top1: DataFrame, query: str, document: str) -> DataFrame:
    """One row: share of queries whose first result says the same."""
    same = lambda c: F.lower(X.indexed_text(F.col(c)))
    return top1.agg(F.count("*").alias("n"), F.avg((same(query) == same(document)).cast("int")).alias("rate"))


def ablation(queries: DataFrame, corpora: dict[str, DataFrame], relevant: DataFrame, *, k: int = 5) -> DataFrame:
    """index, and retrieval metrics of each way to index the same corpus (key case_id, text).

    queries: query_id, text; relevant: query_id, case_id of the pairs that count as hits.
    """
    terms = X.tokens(F.col("text"))
    out = None
    for name, corpus in corpora.items():
        found = RT.bm25(queries, "query_id", terms, RT.postings(corpus, "case_id", terms), "case_id").withColumn("bm25", F.round("bm25", 9))
        marked = found.join(relevant.select("query_id", "case_id", F.lit(True).alias("hit")), ["query_id", "case_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        best = RT.first_relevant(marked, ["query_id"], "case_id", F.col("bm25"), F.col("hit"), k)
        every = queries.select("query_id").join(best, "query_id", "left").na.fill(0, ["hits5", "shown5"])
        one = RT.metrics(every).withColumn("index", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# ---- golden and weak labels ----


def labelling_pack(golden: DataFrame, seed: int = 42) -> DataFrame:
    """What labellers of golden cases get: messages and ids in a hashed order, and empty columns for them to fill.

    golden: case_id, opening_message, turns, first_timestamp, source_tweet_ids, conversation_id. The order is a
    number of each row from a window over the pack, which is a sample that people label, not a corpus.
    """
    order = F.row_number().over(Window.orderBy(F.sha2(V.seeded(seed, F.col("case_id")), 256)))
    base = golden.select(
        "case_id", order.alias("labeling_order"), F.coalesce("opening_message", F.lit("")).alias("first_customer_message"), _rendered(F.col("turns")).alias("conversation"),
        F.coalesce(F.col("first_timestamp").cast("string"), F.lit("")).alias("first_timestamp"), F.to_json("source_tweet_ids").alias("source_tweet_ids"), F.col("conversation_id").cast("string").alias("conversation_id"),
    )
    return base.select("*", *[F.lit("").alias(c) for c in GOLD_COLUMNS])


def pack_fingerprint(pack: DataFrame) -> str:
    """sha256 over the hashes of all rows' columns that labellers do not fill, in labelling order; a row gives 64 characters."""
    own = [c for c in pack.columns if c not in GOLD_COLUMNS]
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), "\r\n", "\n"), F.lit("")) for c in own]), 256)
    digest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("labeling_order", "h"))), lambda x: x["h"]), "\n")
    return pack.select("labeling_order", row.alias("h")).agg(F.sha2(F.concat(F.lit(",".join(own) + "\n"), digest), 256)).first()[0]


def verified_golden(golden: DataFrame, assigned: DataFrame, expected: int, columns: tuple[str, ...] = ("customer_id", "conversation_id", "group_id", "opener_key")) -> DataFrame:
    """Checks (column, shared: all zero) of a golden set against the split assignments; NotReady if one fails."""
    n = golden.count()
    if n != expected:
        raise NotReady(f"expected {expected} golden cases, found {n}")
    require_unique(golden, "case_id")
    said = assigned.where("split = 'golden'").select("case_id")
    _none(golden.join(said, "case_id", "left_anti"), "golden cases that the assignments do not call golden")
    _none(said.join(golden, "case_id", "left_anti"), "cases called golden that are not in the golden set")
    checks = leakage(assigned.withColumn("opener_key", F.nullif("opener_key", F.lit(""))), list(columns))
    shared = {r["column"]: r["shared"] for r in checks.collect()}  # one row a column
    if any(shared.values()):
        raise NotReady(f"golden cases share values with train or dev: {shared}")
    return checks


def golden_eval(pack: DataFrame, provenance: DataFrame) -> DataFrame:
    """case_id, order, text, gold intent, provenance, and two subsets: labelled blind by a person; labelled and reviewed in any way."""
    rows = pack.join(provenance.select("case_id", "provenance"), "case_id", "left")
    gold, who = F.trim(F.coalesce("gold_intent", F.lit(""))), F.coalesce("provenance", F.lit(""))
    return rows.select("case_id", F.col("labeling_order").cast("int").alias("labeling_order"), F.col("first_customer_message").alias("text"), gold.alias("gold_intent"), who.alias("provenance"), ((who == "human") & (gold != "")).alias("blind_human"), (who.isin(*REVIEWED) & (gold != "")).alias("all_reviewed"))


def golden_agent(pack: DataFrame, provenance: DataFrame) -> DataFrame:
    """golden_eval with the labels of routing and resolution."""
    return golden_eval(pack, provenance).join(require_unique(pack, "case_id").select("case_id", "gold_should_escalate", "gold_resolution_type"), "case_id", "left")


def golden_review(pack: DataFrame, candidates: DataFrame) -> DataFrame:
    """pack with the candidate intent of each case; NotReady unless every case is labelled and has one."""
    status = L.case_status(F.col("gold_intent"), F.col("gold_should_escalate"), F.col("gold_resolution_type"))
    _none(pack.where(status != "labelled"), "cases that are not labelled")
    out = pack.join(candidates.select("case_id", F.col("intent").alias("candidate_intent")), "case_id", "left")
    _none(out.where("candidate_intent is null"), "cases without a candidate intent")
    return out


def weak_labels(cases: DataFrame, intents: DataFrame, assignments: DataFrame, split: str) -> DataFrame:
    """case_id, split, text, label of a train or dev split: the label is the intent of the case's cluster. Golden cases raise."""
    if split not in ("train", "dev"):
        raise NotReady(f"baselines may use train or dev, not {split!r}")
    rows = cases.join(assignments.where(F.col("split") == split).select("case_id", "split"), "case_id").join(intents.select("cluster_id", "intent"), "cluster_id", "left")
    out = rows.select("case_id", "split", F.coalesce("opening_message", F.lit("")).alias("text"), F.col("intent").alias("label")).where(F.col("label").isNotNull() & (F.trim("text") != ""))
    return require_disjoint(out, assignments.where("split = 'golden'"))


def guide_examples(examples: DataFrame, cases: DataFrame, assignments: DataFrame, forbidden: DataFrame, most: int = 12) -> DataFrame:
    """examples (section, place, case_id, reading) with the first turns of each case; only train cases may be examples, all that is wrong is named at once.

    cases: case_id, turns. The examples are a hand-written list, so their errors are few.
    """
    bad = forbidden.select("case_id", F.lit(True).alias("__bad")).distinct()
    rows = examples.join(bad, "case_id", "left").join(assignments.select("case_id", "split"), "case_id", "left").join(require_unique(cases, "case_id").select("case_id", "turns"), "case_id", "left")
    error = F.when(F.col("__bad"), "is a golden or calibration case").when(~F.col("split").eqNullSafe("train"), F.concat(F.lit("split is "), F.coalesce("split", F.lit("unknown")))).when(F.col("turns").isNull(), "is not in the case table")
    wrong = [f"{r['case_id']} {r['e']}" for r in rows.select("case_id", error.alias("e")).where("e is not null").orderBy("case_id").collect()]
    if wrong:
        raise NotReady("; ".join(wrong))
    return rows.select("section", "place", "case_id", F.slice("turns", 1, most).alias("turns"), (F.size("turns") > most).alias("truncated"), X.collapsed(F.col("reading")).alias("reading"))


def calibration_sheet(sample: DataFrame) -> DataFrame:
    """The sample as labellers of a calibration get it: conversations as text, lists as JSON, and empty columns for them."""
    rounded = {c: F.round(c, 4) for c in ("margin", "weight") if c in sample.columns}
    flat = sample.withColumns({"first_customer_message": F.coalesce("opening_message", F.lit("")), "conversation": _rendered(F.col("turns")), "source_tweet_ids": F.to_json("source_tweet_ids"), **rounded}).drop("opening_message", "turns")
    first = ["case_id", "first_customer_message", "conversation"]
    return flat.select(*first, *[c for c in flat.columns if c not in first], *[F.lit("").alias(c) for c in HUMAN_COLUMNS])


def rating_sheet(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A blind sheet for human ratings of replies: no judge scores; refused if the existing one holds ratings."""
    columns = [f"human_{d}" for d in JUDGED] + ["human_notes"]
    if existing is not None:
        filled = F.lit(False)
        for c in columns:
            if c in existing.columns:
                filled = filled | (F.trim(F.coalesce(c, F.lit(""))) != "")
        _none(existing.where(filled), "the sheet already holds ratings")
    shown = F.array_join(F.transform("evidence", lambda e: e["historical_response"]), " || ")
    return items.select("case_id", F.col("message").alias("customer_message"), "reply", shown.alias("historical_responses"), *[F.lit("").alias(c) for c in columns])


def human_ratings(sheet: DataFrame) -> DataFrame:
    """Rows of a sheet in which every dimension is rated, as integers; NotReady if a rating is not 1 to 5."""
    given = lambda d: F.trim(F.coalesce(f"human_{d}", F.lit("")))
    rated = sheet
    for d in JUDGED:
        rated = rated.where(given(d) != "")
    for d in JUDGED:
        _none(rated.where(~given(d).isin("1", "2", "3", "4", "5")), f"human_{d} must be an integer from 1 to 5")
    return rated.withColumns({f"human_{d}": given(d).cast("int") for d in JUDGED})


# ---- agent runs ----


def stage_outcomes(reasons: Column, reply: Column, draft: Column, grounded: Column, claims: Column) -> dict[str, Column]:
    """policy_action, generation, grounding and classification_failed, read off an agent's result."""
    said = lambda head: F.exists(reasons, lambda r: r.startswith(head))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    generation = F.when(said("reply generation failed"), "error").when(said("the generator returned no reply"), "declined").when(some(reply) | some(draft), "produced").otherwise("not_attempted")
    grounding = F.when(grounded.isNull(), "not_run").when(F.exists(claims, lambda c: c.startswith("could not verify")), "unavailable").when(grounded, "pass").otherwise("fail")
    return {"policy_action": F.when(generation != "not_attempted", "AUTO_HANDLE").otherwise("ESCALATE"), "generation": generation, "grounding": grounding, "classification_failed": said("classification failed")}


def case_records(cases: DataFrame, results: DataFrame, invariant_errors: Column) -> DataFrame:
    """One flat record a case of an agent run, up to the first runtime failure (results.failed) in labelling order; that case is not recorded.

    results: case_id, failed, intent, confidence, multi_intent, action, reasons, reply, internal_draft_reply, grounded, unsupported_claims, evidence.
    """
    rows = cases.join(require_unique(results, "case_id"), "case_id")
    stop = rows.agg(F.min(F.when(F.col("failed"), F.col("labeling_order"))).alias("__stop"))  # one row
    rows = rows.join(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col("labeling_order") < F.col("__stop"))).drop("__stop", "failed")
    stages = stage_outcomes(F.col("reasons"), F.col("reply"), F.col("internal_draft_reply"), F.col("grounded"), F.coalesce("unsupported_claims", F.array().cast("array<string>")))
    return rows.withColumnsRenamed({"intent": "pred_intent", "confidence": "pred_confidence", "action": "final_action", "text": "message"}).withColumns({**stages, "invariant_errors": invariant_errors})


def judge_items(records: DataFrame) -> DataFrame:
    """One item for each reply that was written, sent or not, with its evidence and empty columns for the judge."""
    draft = F.coalesce(F.nullif("reply", F.lit("")), F.nullif("internal_draft_reply", F.lit("")))
    sent = F.coalesce(F.col("reply"), F.lit("")) != ""
    keep = [c for c in ("case_id", "provenance", "message", "gold_intent", "gold_should_escalate", "gold_resolution_type", "grounding", "unsupported_claims", "evidence") if c in records.columns]
    return records.where(draft.isNotNull()).select(*keep, draft.alias("reply"), sent.alias("sent_to_customer"), *[F.lit(None).cast("int").alias(f"judge_{d}") for d in JUDGED])


def unsafe_cases(smoke: DataFrame, assigned: DataFrame) -> DataFrame:
    """case_id, errors of smoke cases that may not be sent to a model; safe cases are not in it.

    smoke: case_id, split, message, customer_id, conversation_id, group_id, tweet_ids. assigned: case_id, split,
    customer_id, conversation_id, group_id, source_tweet_ids, context_tweet_ids, opening_message. What golden
    cases have is joined, not collected. Both may bring opener_key, the digest of the whole text's key; then the start
    of a message will do.
    """
    gold = assigned.where("split = 'golden'")
    opener = lambda df, text: (F.col("opener_key") if "opener_key" in df.columns else X.opener_digest(F.col(text))).alias("__opener")
    blank = (F.trim(F.coalesce("message", F.lit(""))) == "").alias("__blank")
    smoke = smoke.select("case_id", "split", "customer_id", "conversation_id", "group_id", "tweet_ids", blank, opener(smoke, "message"))  # no text is exchanged
    out = smoke.join(assigned.select("case_id", F.col("split").alias("__split")), "case_id", "left")
    for c in ("customer_id", "conversation_id", "group_id"):
        out = out.join(gold.select(F.col(c).cast("string").alias("__k"), F.lit(True).alias(f"__{c}")).where("__k is not null").distinct(), out[c].cast("string") == F.col("__k"), "left").drop("__k")
    ids = gold.select(F.explode(F.concat("source_tweet_ids", "context_tweet_ids")).alias("t")).distinct()
    hit = smoke.select("case_id", F.explode("tweet_ids").alias("t")).join(ids, "t", "left_semi").select("case_id", F.lit(True).alias("__tweets")).distinct()
    openers = gold.select(opener(gold, "opening_message"), F.lit(True).alias("__text")).where("__opener <> ''").distinct()
    out = out.join(hit, "case_id", "left").join(openers, "__opener", "left")
    errors = F.array_compact(F.array(
        F.when(F.col("__split").isNull(), F.lit("no_split")), F.when(~F.col("__split").isin("train", "dev"), F.lit("split_not_allowed")), F.when(F.col("__split") != F.col("split"), F.lit("split_differs")),
        F.when(F.col("__blank"), F.lit("empty_message")), F.when(F.col("__customer_id"), F.lit("customer")), F.when(F.col("__conversation_id"), F.lit("conversation")),
        F.when(F.col("__group_id"), F.lit("group")), F.when(F.col("__tweets"), F.lit("tweets")), F.when(F.col("__text"), F.lit("opening_text")),
    ))
    return out.select("case_id", errors.alias("errors")).where(F.size("errors") > 0)


def smoke_text(x: Column) -> Column:
    """Lower case without mentions, links and hashtags."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), X.MENTION, " "), X.URL, " "), r"(?U)#\w+", " ")
    return F.lower(X.collapsed(x))
