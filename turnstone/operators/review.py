"""Reviews of taxonomies, retrieval and routing: what disagrees, what fails, what to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import scores as SC


def merge_candidates(df: DataFrame, candidate: str, human: str, rate: float = 0.30) -> DataFrame:
    """Pairs of labels that swap members both ways, with the larger of the two rates at least rate."""
    m = SC.confusion(df, candidate, human)
    shares = m.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold"))).where("gold <> predicted")
    pair = shares.withColumn("pair", V.pair_key(F.col("gold"), F.col("predicted"))).groupBy("pair").agg(F.count("*").alias("ways"), F.sum("n").alias("n"), F.max("share").alias("rate"))
    return pair.where((F.col("ways") == 2) & (F.col("rate") >= rate)).select("pair", "n", "rate")


def split_candidates(df: DataFrame, candidate: str, human: str) -> DataFrame:
    """candidate, n, top, purity, second_share, split_candidate: a label whose top human label has under 0.6 and the next one 0.25 or more."""
    w = Window.partitionBy("gold")
    c = SC.confusion(df, candidate, human).withColumns({"cn": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "predicted"))}).withColumn("p", F.col("n") / F.col("cn"))
    at = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    out = c.groupBy(F.col("gold").alias("candidate")).agg(F.max("cn").alias("n"), at(1, "predicted").alias("top"), at(1, "p").alias("purity"), at(2, "p").alias("second_share"))
    return out.withColumn("split_candidate", F.coalesce((F.col("purity") < 0.6) & (F.col("second_share") >= 0.25), F.lit(False)))


def review_signals(df: DataFrame, candidate: str, gold: str) -> DataFrame:
    """signal, subject, n: merge, split, rename, unused and add signals of a reviewed set.

    merge: two labels differ both ways, 3 or more times; split: 3 or more gold labels, the top one at most
    0.6; rename: half or more go to one other label; unused: no gold row; add: a NEW: label of 3 or more.
    """
    m = SC.confusion(df, candidate, gold)
    w = Window.partitionBy("gold")
    top = m.withColumns({"total": F.sum("n").over(w), "kinds": F.count("*").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "predicted"))})
    merge = m.where("gold <> predicted").withColumn("subject", V.pair_key(F.col("gold"), F.col("predicted"))).groupBy("subject").agg(F.count("*").alias("ways"), F.sum("n").alias("n")).where("ways = 2 and n >= 3").select(F.lit("merge").alias("signal"), "subject", "n")
    split = top.where((F.col("k") == 1) & (F.col("kinds") >= 3) & (F.col("n") / F.col("total") <= 0.6)).select(F.lit("split").alias("signal"), F.col("gold").alias("subject"), "n")
    rename = top.where((F.col("gold") != F.col("predicted")) & (F.col("n") / F.col("total") >= 0.5)).select(F.lit("rename").alias("signal"), F.concat_ws("->", "gold", "predicted").alias("subject"), "n")
    used = m.select(F.col("predicted").alias("gold")).distinct()
    unused = m.select("gold").distinct().join(used, "gold", "left_anti").select(F.lit("unused").alias("signal"), F.col("gold").alias("subject"), F.lit(0).cast("long").alias("n"))
    add = df.where(F.col(gold).startswith("NEW:")).groupBy(F.col(gold).alias("subject")).agg(F.count("*").alias("n")).where("n >= 3").select(F.lit("add").alias("signal"), "subject", "n")
    return merge.unionByName(split).unionByName(rename).unionByName(unused).unionByName(add)


def fallback_quality(df: DataFrame, candidate: str, human: str, fallback: str) -> DataFrame:
    c, h = F.col(candidate) == fallback, F.col(human) == fallback
    return df.agg(F.count("*").alias("n"), F.try_divide(F.count_if(c & h), F.count_if(c)).alias("precision"), F.try_divide(F.count_if(c & h), F.count_if(h)).alias("recall"))


def weighted_agreement(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.when(F.col(a) == F.col(b), F.col(weight)).otherwise(0.0)), F.sum(weight)).alias("agreement"), F.sum(weight).alias("weight"))


def judge_summary(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, mean, share_4 and counts of 1 to 5, from one row a case."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dimensions])).alias("x")).select("x.*").where("score is not null")
    return long.groupBy("dimension").agg(F.avg("score").alias("mean"), F.avg((F.col("score") >= 4).cast("int")).alias("share_4"), *[F.count_if(F.col("score") == s).alias(f"n_{s}") for s in range(1, 6)])


def failure_modes(records: DataFrame) -> DataFrame:
    """mode, n of routing records (message, intent, gold_intent, action, should_escalate, reasons, reply, error)."""
    auto, esc, should = F.col("action") == "AUTO_HANDLE", F.col("action") == "ESCALATE", F.col("should_escalate")
    modes = {
        "model_error": F.coalesce(F.col("error"), F.lit("")) != "", "wrong_intent": F.col("intent") != F.col("gold_intent"), "low_information": X.count_words(F.col("message")) < 3, "needless_escalation": esc & ~should,
        "missed_escalation": auto & should, "hard_rule_gap": auto & should & (F.size("reasons") == 0), "empty_reply": auto & (F.coalesce(F.trim("reply"), F.lit("")) == ""),
    }
    one = records.agg(*[F.count_if(c).alias(n) for n, c in modes.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("mode"), F.col(n).alias("n")) for n in modes])).alias("x")).select("x.*")


def hard_rule(message: Column, intent: Column, blocked: tuple[str, ...], least_words: int = 3) -> Column:
    """Whether a rule alone escalates a message of this intent: blocked intent, sensitive wording or too few words."""
    wording = F.lit(False)
    for pattern in R.SENSITIVE:
        wording = wording | F.rlike(F.lower(message), F.lit(pattern))
    return F.coalesce(intent.isin(*blocked), F.lit(False)) | F.coalesce(wording, F.lit(False)) | (X.count_words(message) < least_words)


def failure_report(cases: DataFrame, records: DataFrame, searches: DataFrame, blocked: tuple[str, ...], unclear: str, shown: int = 4) -> DataFrame:
    """mode, n, of: how often each way to fail was seen, and among how many.

    cases: message, blind, gold_intent, predicted, confidence, should_escalate, notes, other_agent_turns
    of labelled cases; records: action, should_escalate, generation, grounding, reasons of an agent
    run; searches: best, the rank of a query's first relevant document or null. Rules are tried on
    the gold intents of blind cases, as if the classifier were perfect. Each table is read once,
    and its aggregate is one row; confused pairs are counted in a table of label pairs.
    """
    blind = F.coalesce(F.col("blind"), F.lit(False))
    judged = blind & F.col("predicted").isNotNull()
    wrong = judged & (F.col("predicted") != F.col("gold_intent"))
    rule, should = hard_rule(F.col("message"), F.col("gold_intent"), blocked), F.col("should_escalate")
    noted = F.rlike(F.lower(F.coalesce("notes", F.lit(""))), F.lit("another operator|other operator"))
    every = F.lit(True)
    of_cases = {
        "intent_errors": (wrong, judged), "confident_errors": (wrong & (F.col("confidence") >= 0.9), wrong), "policy_over_escalation": (blind & ~should & rule, blind & ~should), "unsafe_auto_handle": (blind & should & ~rule, blind & should),
        "other_operator": ((F.coalesce("other_agent_turns", F.lit(0)) > 0) | noted, every), "low_information": (F.col("gold_intent") == unclear, every), "short_openings": (X.count_words(F.col("message")) < 3, every),
    }
    attempted, grounded = F.col("generation") != "not_attempted", F.col("grounding") != "not_run"
    of_records = {
        "observed_over_escalation": (~should & (F.col("action") == "ESCALATE"), ~should), "observed_unsafe": (should & (F.col("action") == "AUTO_HANDLE"), every), "generation_failures": (attempted & F.col("generation").isin("declined", "error"), attempted),
        "grounding_failures": (grounded & F.col("grounding").isin("fail", "unavailable"), grounded), "insufficient_evidence": (F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in ("weak_retrieval", "insufficient_evidence", "intent_disagreement")])), every),
    }
    of_searches = {"retrieval_misses": (F.coalesce(F.col("best") > 5, F.lit(True)), every)}

    def counted(df: DataFrame, modes: dict[str, tuple[Column, Column]]) -> DataFrame:
        one = df.agg(*[F.struct(F.lit(m).alias("mode"), F.count_if(n).alias("n"), F.count_if(of).alias("of")).alias(m) for m, (n, of) in modes.items()])
        return one.select(F.explode(F.array(*modes)).alias("x")).select("x.*")

    pairs = cases.where(wrong).groupBy(V.pair_key(F.col("gold_intent"), F.col("predicted")).alias("pair")).agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.orderBy(F.desc("k"), "pair"))  # a row a pair of labels
    boundary = pairs.withColumn("p", place).agg(F.coalesce(F.sum(F.when(F.col("p") <= shown, F.col("k"))), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("of")).select(F.lit("intent_boundary").alias("mode"), "n", "of")
    return counted(cases, of_cases).unionByName(boundary).unionByName(counted(records, of_records)).unionByName(counted(searches, of_searches))


def miss_kind(best: Column, same_intent: Column, same_resolution: Column, tokens: Column) -> Column:
    """Why a query has no hit in the top 5."""
    return F.when(best <= 5, "hit").when(tokens < 2, "low_information").when(same_intent & ~same_resolution, "same_intent_other_resolution").when(~same_intent, "other_intent").otherwise("no_relevant_document")


def near_duplicate_rate(top1: DataFrame, similarity: str, least: float = 0.95) -> DataFrame:
    return top1.agg(F.count("*").alias("n"), F.avg((F.col(similarity) >= least).cast("int")).alias("rate"))


def one_per_group(df: DataFrame, key: str, by: str, n: int = 6) -> DataFrame:
    """At most one row a group in hash order of the key, n in all."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.col(key).cast("string"), 256)))
    return df.withColumn("__p", place).where("__p = 1").orderBy(F.sha2(F.col(key).cast("string"), 256)).limit(n).drop("__p")


def calibration_sample(df: DataFrame, key: str, by: str, margin: str, n: int, seed: int = 42) -> DataFrame:
    """Quota a stratum: half from rows in the lowest 40 % of margins, the rest in hash order; weight = eligible / selected."""
    q = SC.quotas(df.groupBy(by).agg(F.count("*").alias("n")), by, n)
    cut = df.groupBy(by).agg(F.percentile(margin, 0.4).alias("__cut"), F.count("*").alias("eligible"))
    rows = df.join(cut, by).join(q, by).withColumn("hard", F.col(margin) <= F.col("__cut"))
    order = F.sha2(V.seeded(seed, F.col(key)), 256)
    rows = rows.withColumn("__first", (F.col("hard") & (F.row_number().over(Window.partitionBy(by, "hard").orderBy(order)) <= F.ceil(F.col("quota") / 2))))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__first"), order))).where("__place <= quota")
    return rows.withColumns({"reason": F.when(F.col("__first"), "low_margin").otherwise("diverse"), "weight": F.col("eligible") / F.least("quota", "eligible")}).drop("__cut", "__first", "__place")


def scenario_picks(df: DataFrame, key: str, scorers: dict[str, Column], seed: int = 42) -> DataFrame:
    """scenario, key: for each scenario in order, the best-scoring row not taken before (ties by hash).

    As many candidates of a scenario as there are scenarios suffice, so only those leave the table.
    """
    need = len(scorers)
    out, taken = [], set()
    for name, score in scorers.items():
        ranked = df.select(F.col(key).alias("k"), score.alias("s")).where("s > 0").orderBy(F.desc("s"), F.sha2(V.seeded(seed, F.col("k")), 256)).limit(need)
        pick = next((r["k"] for r in ranked.collect() if r["k"] not in taken), None)
        if pick is not None:
            taken.add(pick)
            out.append((name, pick))
    return df.sparkSession.createDataFrame(out, f"scenario string, {key} {dict(df.dtypes)[key]}")


def status(passed: Column, failed: Column, unavailable: Column, expected: Column) -> Column:
    """PASS, PARTIAL or FAIL of a smoke run."""
    return F.when((failed > 0) & (passed == 0), "FAIL").when((failed > 0) | (unavailable > 0) | (passed < expected), "PARTIAL").otherwise("PASS")


def normalised_classification(df: DataFrame, intents: DataFrame, fallback: str = "unclear_or_media_only") -> DataFrame:
    """intent, confidence and alternative checked against the taxonomy: unknown intents become the fallback with confidence 0."""
    known = intents.select(F.col("intent").alias("__i")).distinct()
    c = df.withColumns({"__want": V.label(F.col("intent")), "__alt": V.label(F.col("alternative")), "__conf": V.confidence(F.col("confidence"))})
    c = c.join(known.withColumn("__ok", F.lit(True)), F.col("__want") == F.col("__i"), "left").drop("__i").join(known.withColumn("__alt_ok", F.lit(True)), F.col("__alt") == F.col("__i"), "left").drop("__i")
    ok = F.coalesce("__ok", F.lit(False))
    intent = F.when(ok, F.col("__want")).otherwise(fallback)
    return c.withColumns({"intent": intent, "confidence": F.when(ok, F.coalesce("__conf", F.lit(0.0))).otherwise(0.0), "alternative": F.when(F.col("__alt_ok") & (F.col("__alt") != intent), F.col("__alt"))}).drop("__want", "__alt", "__conf", "__ok", "__alt_ok")
