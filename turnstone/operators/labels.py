"""Label state: replay of an audit log, validation, status, registry decisions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import values as V
from turnstone.operators import graph

NEW_LABEL = r"^NEW:[a-z][a-z0-9]*(_[a-z0-9]+)*$"


def replayed(events: DataFrame) -> DataFrame:
    """case_id, value, saves, provenance of labels that stand after the log (case_id, seq, action, value).

    A clear removes all before it. One save is human, a draft alone is draft, a save after a
    draft with its value is confirmed, else corrected; further saves are corrected. Aggregates
    only, so a case with a very long log needs no sorted list.
    """
    cleared = events.groupBy("case_id").agg(F.max(F.when(F.col("action") == "clear", F.col("seq"))).alias("__cleared"))
    live = events.join(cleared, "case_id").where((F.col("action") != "clear") & (F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared"))))
    draft = F.col("action") == "draft"
    per = live.groupBy("case_id").agg(F.max_by("value", "seq").alias("value"), F.count_if(~draft).alias("saves"), F.max_by("value", F.when(draft, F.col("seq"))).alias("drafted"))
    word = F.when(F.col("saves") == 0, "draft").when(F.col("drafted").isNotNull(), F.when(F.col("drafted") == F.col("value"), "confirmed").otherwise("corrected")).when(F.col("saves") == 1, "human").otherwise("corrected")
    return per.withColumn("provenance", word).drop("drafted")


def folded(state: DataFrame, events: DataFrame) -> DataFrame:
    """state (case_id, value, saves, drafted, seq) after further events (case_id, seq, action, value).

    What is left of a case's log is enough to go on, so a reader never replays the whole of it;
    events at or before a case's seq are ones it has seen.
    """
    seen = state.select("case_id", F.col("seq").alias("__seen"))
    new = events.join(seen, "case_id", "left").where(F.col("__seen").isNull() | (F.col("seq") > F.col("__seen")))
    cleared = new.groupBy("case_id").agg(F.max(F.when(F.col("action") == "clear", F.col("seq"))).alias("__cleared"), F.max("seq").alias("__last"))
    live = new.join(cleared.select("case_id", "__cleared"), "case_id").where((F.col("action") != "clear") & (F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared"))))
    draft = F.col("action") == "draft"
    fresh = live.groupBy("case_id").agg(F.max_by("value", "seq").alias("__value"), F.count_if(~draft).alias("__saves"), F.max_by("value", F.when(draft, F.col("seq"))).alias("__drafted"))
    rows = state.join(cleared, "case_id", "full").join(fresh, "case_id", "left")
    keep = F.col("__cleared").isNull()
    return rows.select(
        "case_id", F.coalesce("__value", F.when(keep, F.col("value"))).alias("value"), (F.coalesce(F.when(keep, F.col("saves")), F.lit(0)) + F.coalesce("__saves", F.lit(0))).alias("saves"),
        F.coalesce("__drafted", F.when(keep, F.col("drafted"))).alias("drafted"), F.greatest("seq", "__last").alias("seq"),
    )


def standing(state: DataFrame) -> DataFrame:
    """case_id, value, saves, provenance of the labels in a folded state, as replayed() gives them."""
    word = F.when(F.col("saves") == 0, "draft").when(F.col("drafted").isNotNull(), F.when(F.col("drafted") == F.col("value"), "confirmed").otherwise("corrected")).when(F.col("saves") == 1, "human").otherwise("corrected")
    return state.where("value is not null").select("case_id", "value", "saves", word.alias("provenance"))


def label_errors(intent: Column, resolution: Column, escalate: Column, intents: list[str], resolutions: list[str]) -> Column:
    """All errors of a label, as an array; an empty one is valid."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank(intent), F.lit("intent_missing")), F.when(~blank(intent) & ~intent.isin(*intents) & ~F.rlike(intent, F.lit(NEW_LABEL)), F.lit("intent_unknown")),
        F.when(blank(resolution), F.lit("resolution_missing")), F.when(~blank(resolution) & ~resolution.isin(*resolutions), F.lit("resolution_unknown")), F.when(~F.coalesce(escalate.isin("yes", "no"), F.lit(False)), F.lit("escalate_not_yes_or_no")),
    ))


def case_status(*fields: Column) -> Column:
    filled = sum(((F.coalesce(F.trim(f), F.lit("")) != "").cast("int") for f in fields), F.lit(0))
    return F.when(filled == 0, "unlabelled").when(filled == len(fields), "labelled").otherwise("partial")


def ticket_status(action: Column, reply: Column) -> Column:
    return F.when(action == "AUTO_HANDLE", F.when(F.coalesce(F.trim(reply), F.lit("")) != "", "answered").otherwise("needs_review")).when(action == "ESCALATE", "escalated").otherwise("new")


# ---- decisions: an ordered list of merges, renames and drops ----

ACTIONS = ("merge", "rename", "drop", "new", "edit")


def decision_steps(spark, decisions: list[dict], fallback: str) -> DataFrame:
    """step, source, target: one row for each label that a decision moves; a drop moves to the fallback."""
    rows = [(i, s, d.get("to") or fallback) for i, d in enumerate(decisions) if d["action"] in ("merge", "rename", "drop") for s in d.get("from", [])]
    return spark.createDataFrame(rows, "step long, source string, target string")


def decision_errors(decisions: list[dict], labels: list[str]) -> list[str]:
    """All that is wrong with a list of decisions, in order: unknown actions and labels, targets missing or taken."""
    there, out = set(labels), []
    for i, d in enumerate(decisions):
        kind, sources, target = d.get("action"), d.get("from", []), d.get("to")
        moves = kind in ("merge", "rename", "drop")
        out += [f"{i}: unknown action {kind!r}"] * (kind not in ACTIONS) + [f"{i}: unknown intent {s}" for s in sources if s not in there]
        out += [f"{i}: {kind} needs a target"] * (kind in ("merge", "rename", "new") and not target)
        out += [f"{i}: {target} exists"] * (kind == "new" and target in there or kind == "rename" and target in there - set(sources))
        there = there - set(sources if moves else ()) | ({target} if target else set())
    return out


def label_map(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """label, final: what the ordered steps (step, source, target) make of each label; others stay.

    A step hands on to the next later step that moves its target, so steps form chains; their
    ends are found by pointer jumping, in as many rounds as the logarithm of the longest chain.
    """
    later = steps.select(F.col("step").alias("__next"), F.col("source").alias("target"))
    # steps of one decision list: a row for each label moved
    keyed = graph.saved(steps.select(F.xxhash64("step", "source").alias("node"), "step", "source", "target"))
    follows = keyed.join(later, "target").where("__next > step").groupBy("node", "target").agg(F.min("__next").alias("__next"))
    parents = keyed.select("node").join(follows.select("node", F.xxhash64("__next", "target").alias("parent")), "node", "left")
    ends = graph.ancestors(parents).select("node", "top").join(keyed.select(F.col("node").alias("top"), F.col("target").alias("final")), "top")
    first = keyed.groupBy("source").agg(F.min("step").alias("step")).select(F.col("source").alias("label"), F.xxhash64("step", "source").alias("node"))
    moved = first.join(ends, "node").select("label", "final")
    return labels.select("label").distinct().join(moved, "label", "left").select("label", F.coalesce("final", "label").alias("final"))


def merged_shares(shares: DataFrame, mapped: DataFrame, top: int = 6, digits: int = 3) -> DataFrame:
    """final, n, kind, share, place: share maps (label, n, kind, share) merged by the map, weighted by n; the `top` largest, rounded half-even.

    A kind that a label lacks counts as 0. Counts are added once a label.
    """
    rows = shares.join(mapped, "label")
    total = rows.groupBy("final", "label").agg(F.max("n").alias("n")).groupBy("final").agg(F.sum("n").alias("n"))
    kinds = rows.groupBy("final", "kind").agg(F.sum(F.col("share") * F.col("n")).alias("w")).join(total, "final")
    scored = kinds.select("final", "n", "kind", V.half_even(F.coalesce(F.try_divide(F.col("w"), F.col("n")), F.lit(0.0)), digits).alias("share"))
    place = F.row_number().over(Window.partitionBy("final").orderBy(F.desc("share"), "kind"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def merged_examples(examples: DataFrame, mapped: DataFrame, top: int = 8) -> DataFrame:
    """final, example, place: examples (label, order, example) of merged labels taken in turn, each once, labels by name."""
    rows = examples.join(mapped, "label").groupBy("final", "example").agg(F.min(F.struct("order", "label")).alias("s"))
    place = F.row_number().over(Window.partitionBy("final").orderBy("s.order", "s.label", "example"))
    return rows.select("final", "example", place.alias("place")).where(F.col("place") <= top)


def content_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def anchor_scores(terms: DataFrame, anchors: DataFrame) -> DataFrame:
    """cluster, label, score: the share of a label's anchors (label, anchor) among a cluster's terms (cluster, term); pairs that share none are missing."""
    size = anchors.groupBy("label").agg(F.count_distinct("anchor").alias("__n"))
    hits = terms.join(anchors, F.col("term") == F.col("anchor")).groupBy("cluster", "label").agg(F.count_distinct("term").alias("__hits"))
    return hits.join(size, "label").select("cluster", "label", (F.col("__hits") / F.col("__n")).alias("score"))


def matched_labels(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """cluster, label, score: greedy one-to-one matching by score, then larger cluster, then larger label.

    Pairs that are the best of both their cluster and their label are what the greedy walk
    would take, whatever comes before them; each round matches all of them at once and drops
    the pairs that lost a side.
    """
    left, out = graph.saved(scored.where(F.col("score") >= least)), None
    while not left.isEmpty():
        order = F.struct("score", "cluster", "label")
        by = lambda side: left.groupBy(side).agg(F.max(order).alias("s")).select("s.*")
        both = graph.saved(by("cluster").intersect(by("label")))
        out = both if out is None else out.unionByName(both)
        left = graph.saved(left.join(both.select("cluster"), "cluster", "left_anti").join(both.select("label"), "label", "left_anti"))
    return (left if out is None else out).select("cluster", "label", "score")
