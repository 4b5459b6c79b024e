"""Batch routing of messages: classification, retrieval, policy, and checks of a drafted reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.operators import graph
from turnstone.operators import policy as P
from turnstone.operators import retrieval as RT
from turnstone.operators import taxonomy as TX


def evidence_for(messages: DataFrame, memory: DataFrame, k: int = 5, pool: int = 50) -> DataFrame:
    """case_id (of the message), similarity, intent, response, resolution_type, escalation_signal of the k best records.

    Candidates are BM25's best 50; hashed vectors give the similarity that the policy reads.
    Different texts are searched in different texts: equal messages share an answer, and of the
    records of one text, which all score the same, only the first 50 by case_id can be candidates.
    """
    queries = messages.select(F.col("message").alias("text")).where("text is not null").distinct()
    queries = graph.saved(queries.select(F.sha2("text", 256).alias("query_id"), "text"))
    # a long table of a text each, and the few records that stand for it
    texts = memory.groupBy(F.col("customer_problem").alias("text")).agg(F.min("case_id").alias("text_id"), F.count("*").alias("n"))
    texts = graph.saved(texts)
    first = RT.top_k(memory.select("case_id", F.col("customer_problem").alias("text"), F.lit(0).alias("same")), "text", "case_id", "same", pool)
    members = graph.saved(first.select("case_id", "text").join(texts.select("text", "text_id"), "text").select("text_id", "case_id"))
    terms = X.tokens(F.col("text"))
    scored = RT.bm25(queries, "query_id", terms, RT.postings(texts, "text_id", terms, F.col("n")), "text_id")
    near = RT.top_k(scored, "query_id", "text_id", "bm25", pool).select("query_id", "text_id", "bm25")  # a text has a record at least: no later one is among the best records
    found = RT.top_k(near.join(members, "text_id"), "query_id", "case_id", "bm25", pool)
    vector = lambda df, key, to: df.select(key, TX.hashed_vector(terms).alias(to))
    scored = found.join(vector(queries, "query_id", "qv"), "query_id").join(vector(texts, "text_id", "dv"), "text_id").withColumn("similarity", F.round(RT.dot(F.col("qv"), F.col("dv")), 9)).drop("qv", "dv")
    best = RT.top_k(scored.drop("rank"), "query_id", "case_id", "similarity", k)
    fields = memory.select("case_id", "intent", F.col("historical_response").alias("response"), "resolution_type", "escalation_signal")
    answers = best.join(fields, "case_id").select("query_id", "similarity", "intent", "response", "resolution_type", "escalation_signal")
    return messages.select("case_id", F.sha2("message", 256).alias("query_id")).join(answers, "query_id").drop("query_id")


def handled(messages: DataFrame, memory: DataFrame, drafts: DataFrame) -> DataFrame:
    """messages (case_id, message, intent, confidence, multi_intent, error) with action, reasons and reply.

    drafts: case_id, reply. An error, an empty message or a draft with links or amounts that no
    source has escalates: a reply leaves only if every step succeeded.
    """
    evidence = graph.saved(evidence_for(messages, memory))
    out = P.decided(messages, evidence)
    said = evidence.groupBy("case_id").agg(F.array_join(F.collect_list("response"), " ").alias("__said"))  # k a case
    out = out.join(said, "case_id", "left").join(drafts, "case_id", "left")
    bad = R.unsupported(F.col("reply"), F.concat_ws(" ", "message", "__said"))
    fail = F.array_compact(F.array(
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.lit("model_error")), F.when(F.trim(F.coalesce("message", F.lit(""))) == "", F.lit("empty_message")),
        F.when((F.col("action") == "AUTO_HANDLE") & (F.trim(F.coalesce("reply", F.lit(""))) == ""), F.lit("no_draft")), F.when((F.col("action") == "AUTO_HANDLE") & (F.size(bad) > 0), F.lit("unsupported_facts")),
    ))
    out = out.withColumn("__fail", fail)
    stop = F.size("__fail") > 0
    action = F.when(stop, "ESCALATE").otherwise(F.col("action"))
    return out.withColumns({"action": action, "reasons": F.concat("reasons", "__fail"), "reply": F.when(action == "AUTO_HANDLE", F.col("reply"))}).drop("__fail", "__said")
