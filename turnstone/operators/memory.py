"""Resolution memory: what the customer asked, what was answered, and how far it can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.sources.tables import require_disjoint

# ---- fixed values: limits and wording ----
PROBLEM_CHARS, RESPONSE_CHARS, RESPONSE_TURNS = 500, 420, 2
ESCALATION_ORDER = (("escalated", "customer_relations_or_formal_route"), ("redirected_to_other_operator", "handoff_to_other_operator"), ("redirected_to_dm", "dm_for_account_lookup"))
PHRASE = {
    "refund": "Agent discussed a refund", "compensation": "Agent discussed compensation or Delay Repay", "account_action": "Agent said it changed or issued something on the booking",
    "redirected_to_dm": "Agent asked the customer to continue in DM", "redirected_to_other_operator": "Agent pointed the customer to another operator", "escalated": "Agent referred or escalated the case",
    "troubleshooting": "Agent gave troubleshooting steps", "self_service": "Agent pointed to a self-service route (link, form or station staff)", "feedback_acknowledged": "Agent acknowledged and passed on the feedback",
    "information_provided": "Agent provided information", "clarification_requested": "Agent asked a clarifying question", "other": "Agent replied without a clear resolution action", "unresolved": "No resolving reply in the public thread",
}
OUTCOME = {
    "customer_confirmed": "customer confirmed it helped", "agent_closed": "agent closed the thread", "agent_answered_unconfirmed": "agent answered, no customer confirmation", "customer_followup_unanswered": "customer followed up and was not answered",
    "redirected_to_channel": "moved to another channel", "redirected_to_dm": "moved to DM", "agent_awaiting_customer": "agent was waiting for the customer", "no_response": "no brand reply",
}


def _worded(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), table.items(), F).otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def customer_problem(turns: Column) -> Column:
    """Customer turns before the first brand reply, else the first customer turn; cleaned, joined, clipped."""
    clean = lambda t: X.strip_urls(X.display_text(t["text"]))
    place = F.array_position(F.transform(turns, lambda t: t["role"]), "brand_agent").cast("int")
    before = F.when(place > 0, F.slice(turns, F.lit(1), place - 1)).otherwise(turns)
    said = F.filter(F.transform(F.filter(before, lambda t: t["role"] == "customer"), clean), lambda x: x != "")
    first = F.slice(F.filter(turns, lambda t: t["role"] == "customer"), 1, 1)
    return X.clip(F.array_join(F.when(F.size(said) > 0, said).otherwise(F.transform(first, clean)), " "), PROBLEM_CHARS)


def response_turns(turns: Column, evidence: Column, kind: Column) -> Column:
    """Brand turns that carried the resolution: evidence of its type, else any, else the first reply; useful ones first, two at most."""
    brand = F.filter(turns, lambda t: t["role"] == "brand_agent")
    ids = lambda e: F.transform(e, lambda x: x["tweet_id"])
    own = ids(F.filter(evidence, lambda e: e["signal"] == kind))
    wanted = F.when(F.size(own) > 0, own).otherwise(ids(evidence))
    fits = F.filter(brand, lambda t: F.array_contains(wanted, t["tweet_id"]))
    chosen = F.when(F.size(fits) > 0, fits).otherwise(F.slice(brand, 1, 1))
    words = lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))
    useful = F.filter(chosen, lambda t: (words(X.strip_urls(X.display_text(t["text"]))) >= 4) | F.rlike(t["text"], F.lit(X.URL)))
    return F.slice(F.when(F.size(useful) > 0, useful).otherwise(chosen), 1, RESPONSE_TURNS)


def historical_response(chosen: Column) -> Column:
    texts = F.filter(F.transform(chosen, lambda t: X.display_text(t["text"])), lambda x: x != "")
    return F.when(F.size(texts) == 1, X.clip(texts[0], RESPONSE_CHARS)).otherwise(F.array_join(F.transform(texts, lambda t: X.clip(t, RESPONSE_CHARS // 2)), " | "))


def escalation_signal(signals: Column) -> Column:
    return reduce(lambda w, kv: w.when(F.array_contains(signals, kv[0]), kv[1]), ESCALATION_ORDER, F).otherwise("none")


def summary(kind: Column, outcome: Column, evidence: Column, dm: Column) -> Column:
    line = F.get(F.filter(evidence, lambda e: (e["signal"] == kind) & (e["snippet"] != "")), F.lit(0))["snippet"]
    also = F.when(dm & (kind != "redirected_to_dm") & ~F.contains(outcome, F.lit("dm")), " The agent also asked to move to DM.").otherwise("")
    quote = F.when(line.isNotNull(), F.concat(F.lit(' Key line: "'), X.clip(X.unescaped(line), 170), F.lit('"'))).otherwise("")
    return F.concat(_worded(kind, PHRASE), F.lit("; "), _worded(outcome, OUTCOME), F.lit("."), also, quote)


def built(cases: DataFrame, clusters: DataFrame, intents: DataFrame, splits: DataFrame) -> DataFrame:
    """One record a case. clusters: case_id, cluster_id; intents: cluster_id, intent; splits: case_id, split."""
    rows = cases.join(clusters, "case_id").join(intents, "cluster_id", "left").join(splits, "case_id")
    rows = rows.withColumn("__chosen", response_turns(F.col("turns"), F.col("resolution_evidence"), F.col("resolution_type")))
    rows = rows.withColumns({"customer_problem": customer_problem(F.col("turns")), "historical_response": F.coalesce(historical_response(F.col("__chosen")), F.lit(""))})
    kept = R.evidence_quality(F.col("customer_problem"), F.col("historical_response"), F.col("agent_turn_count"), F.col("resolution_type"), F.col("intent"), F.col("is_continuation"), F.col("starts_with_customer"))
    rows = rows.withColumn("__q", kept)
    return rows.select(
        "case_id", "split", "conversation_id", "intent", F.lit("candidate_taxonomy_not_ground_truth").alias("intent_source"), "cluster_id", "customer_problem", "historical_response",
        summary(F.col("resolution_type"), F.col("outcome"), F.col("resolution_evidence"), F.col("dm_redirect")).alias("resolution_summary"), "resolution_type", F.col("outcome").alias("resolution_outcome"), "resolved", "dm_redirect",
        escalation_signal(F.col("resolution_signals")).alias("escalation_signal"), F.lit("historical_agent_behaviour").alias("escalation_signal_source"), F.col("__q.quality").alias("evidence_quality"), (F.col("__q.quality") == "strong").alias("in_primary_corpus"),
        F.col("__q.reason").alias("exclusion_reason"), F.transform("turns", lambda t: t["tweet_id"]).alias("source_tweet_ids"), F.transform("__chosen", lambda t: t["tweet_id"]).alias("response_tweet_ids"), "context_tweet_ids", F.col("agent_turn_count").alias("n_brand_turns"), "first_timestamp",
    )


def retrievable(memory: DataFrame, assignments: DataFrame) -> DataFrame:
    """The strong records, after a check that none is of a case outside the train split."""
    return require_disjoint(memory, assignments.where("split <> 'train'")).where("in_primary_corpus")
