"""Routing: a deterministic policy over a classification and retrieved evidence, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X

# ---- fixed values: thresholds ----
SETTINGS = {
    "min_classifier_confidence": 0.75, "min_top_similarity": 0.60, "min_usable_similarity": 0.55, "min_usable_evidence": 3, "min_response_words": 4,
    "min_intent_agreement": 0.6, "min_resolution_consistency": 0.4, "escalate_human_signal_share": 0.4, "min_message_words": 3,
}
HUMAN_SIGNALS = ("dm_for_account_lookup", "customer_relations_or_formal_route")
BLOCKED_INTENTS = ("unclear_or_media_only", "service_status_delay_enquiry", "journey_disruption_complaint", "delay_repay_refund_claim", "customer_service_complaint")


def decided(cases: DataFrame, evidence: DataFrame, settings: dict = SETTINGS, blocked: tuple[str, ...] = BLOCKED_INTENTS, key: str = "case_id") -> DataFrame:
    """cases (message, intent, confidence, multi_intent) with action, decision_confidence and reasons.

    evidence: key, similarity, intent, response, resolution_type, escalation_signal; a handful a case.
    """
    s = settings
    e = evidence.join(cases.select(key, F.col("intent").alias("__intent")), key)
    usable = F.coalesce((F.col("similarity") >= s["min_usable_similarity"]) & (X.count_words(F.col("response")) >= s["min_response_words"]), F.lit(False))
    e = e.withColumn("__usable", usable)
    per = e.groupBy(key).agg(F.count("*").alias("n_evidence"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("top_similarity"), F.count_if("__usable").alias("n_usable"), F.count_if(F.col("__usable") & (F.col("intent") == F.col("__intent"))).alias("n_agree"), F.count_if(F.col("__usable") & F.col("escalation_signal").isin(*HUMAN_SIGNALS)).alias("n_human"))
    common = e.where("__usable").groupBy(key, "resolution_type").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n_common"))
    rows = cases.join(per, key, "left").join(common, key, "left").na.fill(0, ["n_evidence", "n_usable", "n_agree", "n_human", "n_common"]).na.fill(0.0, ["top_similarity"])
    share = lambda c: F.col(c) / F.col("n_usable")
    some = F.col("n_usable") > 0
    words = R.sensitive_words(F.col("message"))
    hard = F.array_compact(F.array(
        F.when(X.count_words(F.col("message")) < s["min_message_words"], F.lit("low_information")), F.when(F.col("intent").isin(*blocked), F.lit("blocked_intent")),
        F.when(F.col("multi_intent"), F.lit("multi_intent")), F.when(F.size(words) > 0, F.lit("sensitive_wording")),
    ))
    soft = F.array_compact(F.array(
        F.when(F.col("confidence") < s["min_classifier_confidence"], F.lit("low_confidence")), F.when(F.col("n_evidence") == 0, F.lit("no_evidence")),
        F.when((F.col("n_evidence") > 0) & (F.col("top_similarity") < s["min_top_similarity"]), F.lit("weak_retrieval")), F.when((F.col("n_evidence") > 0) & (F.col("n_usable") < s["min_usable_evidence"]), F.lit("insufficient_evidence")),
        F.when(some & (share("n_agree") < s["min_intent_agreement"]), F.lit("intent_disagreement")), F.when(some & (share("n_common") < s["min_resolution_consistency"]), F.lit("inconsistent_resolutions")),
        F.when(some & (share("n_human") >= s["escalate_human_signal_share"]), F.lit("needs_human")),
    ))
    weakest = F.least(F.col("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top_similarity"))), F.when(some, share("n_agree")).otherwise(0.0))
    rows = rows.withColumns({"__hard": hard, "__soft": soft, "__weakest": weakest})
    escalate = (F.size("__hard") > 0) | (F.size("__soft") > 0)
    return rows.withColumns({
        "action": F.when(escalate, "ESCALATE").otherwise("AUTO_HANDLE"), "reasons": F.concat("__hard", "__soft"),
        "decision_confidence": F.when(F.size("__hard") > 0, 1.0).otherwise(F.round(F.when(escalate, 1.0 - F.col("__weakest")).otherwise(F.col("__weakest")), 3)),
    }).drop("__hard", "__soft", "__weakest")


def routing_metrics(records: DataFrame) -> DataFrame:
    """One row over action and should_escalate; ratios are null on empty denominators."""
    auto, esc = F.col("action") == "AUTO_HANDLE", F.col("action") == "ESCALATE"
    should = F.col("should_escalate")
    c = F.count_if
    return records.agg(
        F.count("*").alias("n"), F.try_divide(c(esc), F.count("*")).alias("escalation_coverage"), F.try_divide(c(auto & ~should), F.count("*")).alias("safe_automation"),
        F.try_divide(c(auto & should), c(auto)).alias("false_auto_handle"), F.try_divide(c(esc & should), c(esc)).alias("escalation_precision"), F.try_divide(c(esc & should), c(should)).alias("escalation_recall"),
    )


def reason_histogram(records: DataFrame) -> DataFrame:
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reply_stats(replies: DataFrame, text: str = "text") -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    n = F.size(F.filter(F.split(X.collapsed(x), " "), lambda w: w != ""))
    share = lambda p: F.avg(p.cast("int"))
    return replies.agg(
        F.count("*").alias("n"), F.avg(n).alias("mean_words"), F.median(n).alias("median_words"), share(n <= 60).alias("share_60_words"), share(F.rlike(x, F.lit(r"https?://"))).alias("share_link"),
        share(F.contains(x, F.lit("?"))).alias("share_question"), share(F.rlike(F.lower(x), F.lit(r"\bdm\b|direct message"))).alias("share_dm"),
    )


def invariant_errors(action: Column, reply: Column, reasons: Column, evidence: Column, confidence: Column) -> Column:
    """What a routing result must never be, as an array of names."""
    empty = F.coalesce(F.trim(reply), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(~action.isin("AUTO_HANDLE", "ESCALATE"), F.lit("unknown_action")), F.when((action == "AUTO_HANDLE") & empty, F.lit("auto_without_reply")), F.when((action == "ESCALATE") & ~empty, F.lit("escalated_with_reply")),
        F.when(F.size(reasons) == 0, F.lit("no_reason")), F.when((action == "AUTO_HANDLE") & (evidence == 0), F.lit("auto_without_evidence")), F.when(~confidence.between(0, 1), F.lit("confidence_out_of_range")),
    ))


def observation_flags(cases: DataFrame, evidence: DataFrame, fallback: str = "unclear_or_media_only", key: str = "case_id") -> DataFrame:
    """key, flags: what a person should look at in a routing result; not verdicts.

    cases: key, message, intent, candidate_intent, multi_intent, action, reasons, grounded, escalation_signal, dm_redirect;
    evidence: key, evidence_case_id, intent, resolution_type, a handful a case.
    """
    e = evidence.join(cases.select(key, F.col("intent").alias("__intent")), key)
    per = e.groupBy(key).agg(F.count("*").alias("__n"), F.count_if(F.col("intent") != F.col("__intent")).alias("__other"), F.bool_or(F.col("evidence_case_id").cast("string") == F.col(key).cast("string")).alias("__self"))
    common = e.groupBy(key, "resolution_type").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("__common"))
    c = cases.join(per, key, "left").join(common, key, "left")
    auto, differs = F.col("action") == "AUTO_HANDLE", F.col("candidate_intent").isNotNull() & (F.col("intent") != F.col("candidate_intent"))
    flags = F.array_compact(F.array(
        F.when(differs, F.lit("intent_differs_from_candidate")), F.when(F.col("__n").isNull(), F.lit("no_evidence")), F.when(F.col("__common") / F.col("__n") < 0.5, F.lit("mixed_resolutions")),
        F.when(F.col("__other") / F.col("__n") > 0.5, F.lit("mostly_other_intents")), F.when(F.col("__self"), F.lit("retrieved_itself")), F.when(X.count_words(F.col("message")) < SETTINGS["min_message_words"], F.lit("low_information")),
        F.when(F.col("multi_intent"), F.when(auto, F.lit("multi_intent_flagged")).otherwise(F.lit("multi_intent_escalation"))), F.when(F.col("intent") == fallback, F.lit("fallback_intent")),
        F.when(F.exists("reasons", lambda r: r.startswith("the generator returned no reply")), F.lit("no_reply_generated")), F.when(~F.col("grounded"), F.lit("grounding_failed")),
        F.when(auto & (F.col("escalation_signal").isin(*HUMAN_SIGNALS) | F.coalesce("dm_redirect", F.lit(False))), F.lit("auto_on_escalation_like_case")),
    ))
    return c.select(key, flags.alias("flags"))
