"""Episodes: owners of messages, gap segmentation, tails, numbering, context; and their cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import rules as R
from turnstone.functions import text as X
from turnstone.functions import values as V
from turnstone.operators import graph


def turn_order() -> list[Column]:
    """Time (nulls last), reply depth, id."""
    return [F.asc_nulls_last("created_at"), F.col("reply_depth"), F.col("tweet_id")]


def with_depth(rows: DataFrame) -> DataFrame:
    """reply_depth and __customer: the nearest customer message above (parents within the thread only)."""
    home = rows.select(F.col("tweet_id").alias("parent_tweet_id"), F.col("conversation_id").alias("__c"))
    inside = rows.join(home, "parent_tweet_id", "left").select(F.col("tweet_id").alias("node"), F.when(F.col("__c") == F.col("conversation_id"), F.col("parent_tweet_id")).alias("parent"), (F.col("role") == "customer").alias("is_customer"))
    up = graph.ancestors(inside, "is_customer").select(F.col("node").alias("tweet_id"), F.col("depth").alias("reply_depth"), F.col("found").alias("__customer"))
    return rows.join(up, "tweet_id")


def owned(rows: DataFrame) -> DataFrame:
    """owner_id and owner_source: self, parent_chain, mention or sole_customer."""
    author = rows.select(F.col("tweet_id").alias("__customer"), F.col("author_id").cast("string").alias("__up"))
    people = rows.where("role = 'customer'").groupBy("conversation_id").agg(F.collect_set(F.col("author_id").cast("string")).alias("__people"))
    named = F.get(F.filter(X.mentions(F.col("text"), digits=True), lambda m: F.array_contains("__people", m)), F.lit(0))
    sole = F.when(F.size("__people") == 1, F.element_at("__people", 1))
    picks = [("self", F.when(F.col("role") == "customer", F.col("author_id").cast("string"))), ("parent_chain", F.col("__up")), ("mention", named), ("sole_customer", sole)]
    rows = rows.join(author, "__customer", "left").join(people, "conversation_id", "left")
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in picks])
    return rows.withColumns({"owner_id": F.coalesce(*[c for _, c in picks]), "owner_source": source}).drop("__customer", "__up", "__people")


def gap_segments(rows: DataFrame, keys: list[str], gap_hours: float = 24.0, time: str = "created_at", order: list | None = None) -> DataFrame:
    """segment (from 0): a gap strictly longer than gap_hours starts one; null times never do."""
    w = Window.partitionBy(*keys).orderBy(*(order or turn_order()))
    gap = F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))
    starts = F.coalesce((gap > F.lit(int(gap_hours * 3_600_000_000))).cast("int"), F.lit(0))
    return rows.withColumn("__starts", starts).withColumn("segment", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__starts")


def merged_tails(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Agent-only segments join the owner's segment before; segment is numbered anew."""
    per = rows.groupBy(*keys, "segment").agg(F.bool_or(F.col("role") == "customer").alias("__own"))
    w = Window.partitionBy(*keys).orderBy("segment")
    first = F.row_number().over(w) == 1
    per = per.withColumn("__start", (F.col("__own") | first).cast("int"))
    per = per.withColumn("__new", (F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__own", "__start")
    return rows.join(per, [*keys, "segment"]).withColumn("segment", F.col("__new")).drop("__new")


def segmented(rows: DataFrame, gap_hours: float = 24.0) -> DataFrame:
    """rows (threads with roles) with owner, case_id, episode_seq, continues_case_id, exclusion_reason."""
    every = graph.saved(owned(with_depth(rows)))
    keys = ["conversation_id", "owner_id"]
    mine = merged_tails(gap_segments(every.where("owner_id is not null"), keys, gap_hours), keys)
    inside = Window.partitionBy(*keys, "segment").orderBy(*turn_order())
    mine = mine.withColumn("case_id", F.concat(F.lit("case_"), F.first("tweet_id").over(inside).cast("string")))
    heads = mine.groupBy(*keys, "segment", "case_id").agg(F.min(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "reply_depth", "tweet_id")).alias("head"))
    heads = heads.withColumn("episode_seq", F.row_number().over(Window.partitionBy("conversation_id").orderBy("head")) - 1)
    heads = heads.withColumn("continues_case_id", F.lag("case_id").over(Window.partitionBy(*keys).orderBy("head")))
    out = mine.join(heads.select("case_id", "episode_seq", "continues_case_id"), "case_id").drop("segment")
    alone = every.where("owner_id is null").withColumns({"case_id": F.lit(None).cast("string"), "episode_seq": F.lit(None).cast("int"), "continues_case_id": F.lit(None).cast("string"), "exclusion_reason": F.lit("unattributed_agent_tweet")})
    return out.withColumn("exclusion_reason", F.lit(None).cast("string")).unionByName(alone)


def context_ids(rows: DataFrame) -> DataFrame:
    """case_id, context_tweet_ids: unowned ancestors of the first customer turn, oldest first.

    rows come from segmented(). Each round doubles how far an unowned message's pointer reaches,
    and adds for every ancestor found so far the one that far above it; so n ancestors take about
    log2(n) rounds and no more pairs than the result has. A walk round a cycle ends where it
    would start again.
    """
    place = F.struct(F.col("created_at").isNull(), "created_at", "reply_depth", "tweet_id")
    first = rows.where("case_id is not null").groupBy("case_id").agg(F.coalesce(F.min_by("tweet_id", F.when(F.col("role") == "customer", place)), F.min_by("tweet_id", place)).alias("at"))
    free = rows.where("owner_id is null").select(F.col("tweet_id").alias("up"), F.col("conversation_id").alias("uc"))
    above = graph.saved(rows.select(F.col("tweet_id").alias("at"), F.col("parent_tweet_id").alias("up"), F.col("conversation_id").alias("c")).join(free, "up").where("c = uc").select("at", "up"))
    found = graph.saved(first.join(above, "at").select("case_id", F.col("up").alias("node"), F.lit(0).cast("long").alias("steps")))
    jump = graph.saved(above.join(free.select(F.col("up").alias("at")), "at", "left_semi"))
    last, total, reach = found, jump.count(), 1
    while reach <= total and not last.isEmpty():
        last = graph.saved(found.join(jump, found["node"] == jump["at"]).select("case_id", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps")))
        found = graph.saved(found.unionByName(last))
        further = jump.select(F.col("at").alias("up"), F.col("up").alias("next"))
        jump = graph.saved(jump.join(further, "up").select("at", F.col("next").alias("up")))
        reach *= 2
    each = found.groupBy("case_id", "node").agg(F.min("steps").alias("steps"))
    ids = each.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), "node"))), lambda x: x["node"]).alias("context_tweet_ids"))
    return first.select("case_id").join(ids, "case_id", "left").select("case_id", F.coalesce("context_tweet_ids", F.array().cast("array<bigint>")).alias("context_tweet_ids"))


def turns_of(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """key, turns: array<struct> in turn order. A thread is bounded by its messages, and is one row by design."""
    order = [F.col("created_at").isNull().alias("o1"), F.col("created_at").alias("o2"), (F.col("reply_depth") if "reply_depth" in rows.columns else F.lit(0)).alias("o3"), F.col("tweet_id").alias("o4")]
    body = F.struct("tweet_id", "author_id", "role", "created_at", "text", *more)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, body.alias("turn")))).alias("s")).select(key, F.transform("s", lambda x: x["turn"]).alias("turns"))


def with_signals(rows: DataFrame, operators: list[str] = ()) -> DataFrame:
    """rows with found: the signals of brand turns, null for others."""
    shown = rows.withColumn("__shown", F.when(F.col("role") == "brand_agent", X.display_text(F.col("text")))).withColumn("__low", F.lower("__shown"))
    return shown.withColumn("found", F.when(F.col("role") == "brand_agent", R.turn_signals(F.col("__shown"), F.col("__low"), list(operators)))).drop("__shown", "__low")


#: Quotes of a case at most.
EVIDENCE = 4


def resolutions(rows: DataFrame, key: str) -> DataFrame:
    """key, resolution_type, outcome, resolved, dm_redirect, resolution_signals, resolution_evidence; rows come from with_signals().

    An ordered fold without an array of turns: a case's state is a flag for each signal, its last
    turns, and the first quotes of each signal. All of it is combined on the map side but the
    places of quotes, which a window ranks by case and signal and which spill when a case is
    very long. What is collected is EVIDENCE quotes a signal, however many messages a case has.
    """
    rows = rows.where(F.col(key).isNotNull())
    order = F.struct(F.col("created_at").isNull().alias("o1"), F.col("created_at").alias("o2"), (F.col("reply_depth") if "reply_depth" in rows.columns else F.lit(0)).alias("o3"), F.col("tweet_id").alias("o4"))
    base = rows.select(key, "tweet_id", "role", "text", "found", order.alias("at"))
    brand, agent, names = F.col("role") == "brand_agent", F.col("role") != "customer", F.transform("found", lambda s: s["signal"])
    per = base.groupBy(key).agg(
        F.max_by("role", "at").alias("__role"), F.max_by("text", "at").alias("__text"), F.max_by("text", F.when(agent, F.col("at"))).alias("__agent"), F.bool_or(agent).alias("__any_agent"), F.bool_or(brand).alias("__any_brand"),
        F.max_by(F.struct("tweet_id", "found"), F.when(brand, F.col("at"))).alias("__last"), *[F.coalesce(F.bool_or(brand & F.array_contains(names, s)), F.lit(False)).alias(f"__has_{s}") for s in R.SIGNAL_PRIORITY],
    )
    per = per.withColumns({"__lc": X.matching_form(F.col("__text")), "__la": X.matching_form(F.when(F.col("__any_agent"), F.col("__agent"))), "__ends": F.transform("__last.found", lambda s: s["signal"])})
    per = per.withColumn("outcome", R.outcome(F.col("__role") == "customer", F.col("__any_agent"), F.col("__lc"), F.col("__la")))
    chosen = F.coalesce(*[F.when(F.col(f"__has_{s}") & (F.array_contains("__ends", s) if s == "redirected_to_dm" else F.lit(True)), s) for s in R.SIGNAL_PRIORITY])
    unanswered = (F.col("__role") == "customer") & (F.col("outcome") == "customer_followup_unanswered") & chosen.isin("clarification_requested", "other")
    per = per.withColumn("resolution_type", F.when(~F.col("__any_brand") | unanswered, "unresolved").otherwise(chosen))
    quotes = base.where(brand).select(key, "tweet_id", "at", F.posexplode("found").alias("place", "s")).select(key, "tweet_id", "at", "place", "s.signal", "s.snippet").where("signal <> 'other'")
    first = quotes.withColumn("__k", F.row_number().over(Window.partitionBy(key, "signal").orderBy("at"))).where(F.col("__k") <= EVIDENCE)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "place", F.struct("tweet_id", "signal", "snippet").alias("e")))).alias("__quotes"))  # EVIDENCE a signal
    per = per.join(listed, key, "left").withColumn("dm_redirect", F.col("__has_redirected_to_dm"))
    wanted = lambda q: (q["e"]["signal"] == F.col("resolution_type")) | (F.col("dm_redirect") & (q["e"]["signal"] == "redirected_to_dm"))
    fits = F.transform(F.slice(F.filter(F.coalesce("__quotes", F.array()), wanted), 1, EVIDENCE), lambda q: q["e"])
    head = F.get("__last.found", F.lit(0))
    fallback = F.array(F.struct(F.col("__last.tweet_id").alias("tweet_id"), head["signal"].alias("signal"), head["snippet"].alias("snippet")))
    evidence = F.when(~F.col("__any_brand"), F.slice(fallback, 1, 0)).when((F.col("resolution_type") == "unresolved") | (F.size(fits) == 0), fallback).otherwise(fits)
    return per.select(
        key, "resolution_type", "outcome", ((F.col("resolution_type") != "unresolved") & F.col("outcome").isin(*R.RESOLVED_OUTCOMES)).alias("resolved"), "dm_redirect",
        F.array_compact(F.array(*[F.when(F.col(f"__has_{s}"), F.lit(s)) for s in R.SIGNAL_PRIORITY])).alias("resolution_signals"), evidence.alias("resolution_evidence"),
    )


def case_table(rows: DataFrame, key: str = "case_id", operators: list[str] = ()) -> DataFrame:
    """One row a case: counts by role, first response, gaps, duration, switches, openers and resolution."""
    w = Window.partitionBy(key).orderBy(*(turn_order() if "reply_depth" in rows.columns else [F.asc_nulls_last("created_at"), F.col("tweet_id")]))
    rows = rows.where(F.col(key).isNotNull()).withColumns({"__gap": V.hours_between(F.lag("created_at").over(w), F.col("created_at")), "__switch": (F.col("role") != F.lag("role").over(w)).cast("int"), "__n": F.row_number().over(w)})
    role = lambda r: F.col("role") == r
    flat = rows.groupBy(key).agg(
        F.count("*").alias("turn_count"), F.count_if(role("customer")).alias("customer_turn_count"), F.count_if(role("brand_agent")).alias("agent_turn_count"), F.count_if(role("other_agent")).alias("other_agent_turn_count"),
        F.min("created_at").alias("first_timestamp"), F.max("created_at").alias("last_timestamp"), F.max("__gap").alias("max_gap_hours"), F.coalesce(F.sum("__switch"), F.lit(0)).alias("speaker_switches"),
        F.min(F.when(role("customer"), F.col("__n"))).alias("__first_customer"), F.min_by("text", F.when(role("customer"), F.col("__n"))).alias("opening_message"), F.min_by("created_at", F.when(role("customer"), F.col("__n"))).alias("__asked"),
        F.min(F.when(role("brand_agent") & F.col("created_at").isNotNull(), F.col("created_at"))).alias("__answered"), F.min_by("role", "__n").alias("__opens"),
    )
    flat = flat.withColumns({
        "first_response_minutes": F.when(F.col("__answered") >= F.col("__asked"), V.minutes_between(F.col("__asked"), F.col("__answered"))),
        "duration_hours": V.hours_between(F.col("first_timestamp"), F.col("last_timestamp")), "starts_with_customer": F.col("__opens") == "customer", "has_brand_reply": F.col("agent_turn_count") > 0, "length_label": V.length_label(F.col("turn_count")),
    }).drop("__first_customer", "__asked", "__answered", "__opens")
    marked = with_signals(rows, operators)
    # the nested turns of a case are its own row by design; a plan that does not read them does not gather them
    return flat.join(turns_of(marked, key, F.col("found")), key).join(resolutions(marked, key), key)


def related_cases(cases: DataFrame, hours: float = 24.0) -> DataFrame:
    """case_id, related_case_ids: cases of the same customer whose spans come within hours of each other."""
    slack = F.expr(f"make_dt_interval(0, {int(hours)}, 0, 0)")
    spans = cases.where("first_timestamp is not null").select("customer_id", "case_id", F.col("first_timestamp").alias("f"), F.col("last_timestamp").alias("l"))
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.customer_id") == F.col("b.customer_id")) & (F.col("a.case_id") != F.col("b.case_id")) & (F.col("a.f") <= F.col("b.l") + slack) & (F.col("b.f") <= F.col("a.l") + slack)
    pairs = a.join(b, near).groupBy(F.col("a.case_id").alias("case_id")).agg(F.array_sort(F.collect_list("b.case_id")).alias("related_case_ids"))
    return cases.select("case_id").join(pairs, "case_id", "left").select("case_id", F.coalesce("related_case_ids", F.array().cast("array<string>")).alias("related_case_ids"))


def attributed_brand(rows: DataFrame, thread: str = "conversation_id") -> DataFrame:
    """conversation, brand: the modal outbound author (ties: first to write), else the first mention of a known brand, else unknown."""
    out = rows.where("not inbound").groupBy(thread, "author_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("created_at").isNull(), "created_at", "tweet_id")).alias("first"))
    modal = out.groupBy(thread).agg(F.min_by("author_id", F.struct(-F.col("n"), "first")).alias("modal"))
    known = rows.where("not inbound").select(F.lower("author_id").alias("low"), F.col("author_id").alias("known")).groupBy("low").agg(F.min("known").alias("known"))
    said = rows.select(thread, "created_at", "tweet_id", F.posexplode(X.mentions(F.col("text"))).alias("place", "m")).withColumn("low", F.lower("m")).join(known, "low")
    named = said.groupBy(thread).agg(F.min_by("known", F.struct(F.col("created_at").isNull(), "created_at", "tweet_id", "place")).alias("named"))
    return rows.select(thread).distinct().join(modal, thread, "left").join(named, thread, "left").select(thread, F.coalesce("modal", "named", F.lit("unknown")).alias("brand"))
