"""Rule lists: intents by keyword, signals of a reply, outcomes, requested items, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# ---- fixed values: ordered rules; the first match wins ----
INTENTS = (
    ("account_access", r"log ?in|sign ?in|password|locked out|hacked|verification code|2fa|two.factor|can'?t access|reset my"),
    ("cancellation", r"\bcancel(?:l?ed|l?ing|lation)?\b|unsubscribe|close my account|terminate"),
    ("refund_compensation", r"refund|money back|reimburse|compensat|chargeback|credit back"),
    ("billing_payment", r"\bbill(?:ed|ing)?\b|charged|\bcharge\b|payment|\bpaid\b|invoice|overcharg|\bfee\b|subscription|price"),
    ("order_delivery", r"\border\b|deliver|package|parcel|shipping|shipped|tracking|courier|arriv|dispatch"),
    ("travel_disruption", r"flight|delay|\btrain\b|luggage|baggage|boarding|\bgate\b|\bseat\b|connection flight|missed (?:my )?connection|platform"),
    ("connectivity_outage", r"outage|no signal|no service|internet|wi-?fi|\bnetwork\b|\bdata\b|\b[345]g\b|slow speed|\bdown\b"),
    ("technical_issue", r"not working|doesn'?t work|won'?t (?:load|open|work)|error|crash|\bbug\b|broken|glitch|freez|update|battery|keeps"),
    ("how_to_question", r"^(?:how|what|when|where|why|can i|can you|do you|is there|will)\b|\?$"),
    ("complaint", r"worst|terrible|awful|disappoint|rude|ridiculous|unacceptable|useless|disgust|shocking|joke"),
    ("praise", r"\blove\b|thank|great service|amazing|awesome|brilliant|best"),
)
SIGNAL_PRIORITY = (
    "refund", "compensation", "account_action", "redirected_to_dm", "redirected_to_other_operator", "escalated",
    "troubleshooting", "self_service", "feedback_acknowledged", "information_provided", "clarification_requested", "other",
)
_OBJECT = r"(?:ticket|booking|seat|reservation|journey|order|card|account|reference|railcard)s?"
SIGNALS = {
    "redirected_to_dm": r"\b(?:dm|dms|d\.m)\b|direct message|private message|\bpm (?:us|me)\b|message us|(?:send|drop|shoot) us a (?:dm|message|note)",
    "refund": r"\brefund(?:s|ed|ing)?\b|money back|reimburs",
    "compensation": r"delay ?repay|compensat|goodwill|\bvouchers?\b|\bclaim(?:s|ed|ing)?\b|\bcredit(?:ed)?\b",
    "account_action": (
        r"\b(?:i|we)(?:'ve| have|'ll| will)? (?:now )?(?:booked|reserved|amended|changed|cancell?ed|re-?issued|resent|re-?sent|upgraded|arranged|(?:book|reserve|amend|change|cancel|re-?issue|resend|arrange)) "
        rf"[^.?!]{{0,40}}\b{_OBJECT}\b|\byour {_OBJECT} (?:has|have) been (?:booked|reserved|amended|changed|cancell?ed|re-?issued|resent|updated|upgraded|refunded)\b"
    ),
    "escalated": (
        r"customer relations|escalat|\bchase\b|raise[ds]? (?:this|it|that) with|forwarded|(?:will|'ll|can) forward|forward(?:ing)? (?:this|it|that|your)|refer(?:red)? (?:this|you|it)|"
        r"report(?:ed|ing)? (?:this|it|that) to|look(?:ing)? into (?:this|it|that)|(?:team|colleagues) (?:will|are|is|can) (?:look|contact|be in touch)"
    ),
    "feedback_acknowledged": r"feedback|pass(?:ed|ing)? (?:this|that|it|your [a-z]+)? ?(?:on|along|back)\b|\bnoted\b|thanks for (?:letting|telling) us|thank you for (?:letting|telling) us",
    "troubleshooting": (
        r"have you tried|\btry (?:restarting|clearing|logging|a different|another|using a|using the|refreshing|connecting|reconnecting|turning|switching|again later)|clear (?:your )?(?:cache|cookies|history)|"
        r"\b(?:refresh|restart|reboot|re-?install|reconnect)(?:ing)?\b|different (?:browser|device)|new (?:browser|tab)|\bbrowser\b|does (?:it|this) (?:still|work)|\berror (?:message|code)\b|"
        r"(?:turn|switch) (?:it|your [a-z-]+) (?:off|on)|forget the network"
    ),
    "self_service": (
        r"https?://|\b(?:online form|web ?form|contact form|our website|the website|our app|the app|ticket (?:office|machines?)|station team|members? of staff|live updates|journey planner|visit)\b"
    ),
    "clarification_requested": (
        r"(?:which|what|where|when|who|could you|can you|are you|do you|did you|have you|is it|was it)\b[^.?!]*\?|(?:send|provide|confirm|let us know|tell us) (?:us )?(?:your|the|a|what|which)\b"
    ),
}
OPERATOR_HANDOFF = r"pass(?:ing)?|forward|speak to|contact|operate|their|travell?ing (?:with|on)|run by|responsib|best (?:placed|contact)|may be able|can (?:help|confirm|advise)|is a|service"
CONFIRMED = r"\b(thanks|thank you|thank u|thx|ty|cheers|appreciate|sorted|fixed|resolved|solved|works now|working now|that worked|it worked|all good|got it|perfect|brilliant|awesome)\b"
NEGATED = r"\b(not|no|never|still|nothing|doesn't|doesnt|didn't|didnt|won't|wont|can't|cant|isn't|isnt|useless|worst|terrible|awful|ridiculous|joke)\b|\bfor nothing\b"
CLOSING = (
    r"(glad (?:we|i) (?:could|were able)|glad (?:to hear|it's|it is|that's|that worked|you got|everything|you're all set|you were able)|happy to hear|you're welcome|you are welcome|\banytime\b|"
    r"have a (?:great|good|nice|lovely|wonderful|fantastic)|\benjoy\b|no problem|my pleasure|great to hear|good to hear|pleased to hear|we're here if|here if you need|take care|safe travels)"
)
TO_DM = r"(\bdm\b|\bd\.m\b|direct message|private message|\bpm\b|send us a (?:dm|message|note)|message us|via dm|in dm|over dm|\bdms\b|follow and dm|inbox)"
TO_CHANNEL = r"(<url>|call us|give us a call|\bphone\b|contact (?:us|our)|\bvisit\b|support page|\bemail\b|live chat|chat with|help ?cent(?:er|re)|1-?800|\bhotline\b)"
REQUEST_CUE = r"\?|\bplease\b|\bcould you\b|\bcan you\b|\bif you (can|could)\b|\blet us know\b"
REQUESTS = {
    "booking_or_reference_number": r"\b(booking|vt|ticket|order|collection|claim)\s*(ref|reference|number|no)\b|\breference (number|no)\b|\bbooking ref",
    "email_address": r"\be-?mail\b",
    "service_or_train_details": r"\bwhich (service|train)\b|\bwhat (service|train|time)\b|\bservice are you\b|\bwhich station\b|\bwhere are you (travelling|going|heading)\b",
    "photo_or_screenshot": r"\b(photo|picture|screenshot|image)\b",
    "name_or_contact_details": r"\b(your name|full name|phone number|contact number|telephone number|postcode|address)\b",
    "seat_or_coach": r"\b(seat|coach|carriage) (number|no)\b|\bwhich coach\b|\bwhat coach\b",
    "description_of_problem": r"\bwhat (issues|issue|problem|seems|happened)\b|\bmore (details|information)\b|\bwhat (is|are) the (issue|problem)\b",
}
WEAK_TYPES = ("other", "clarification_requested", "unresolved")
RESOLVED_OUTCOMES = ("customer_confirmed", "agent_closed")
THANKS_ONLY = r"(?iU)^(?:ok(?:ay)?|thanks?|thank you|cheers|ta|great|brilliant|perfect|thx)\b[\s\w!.,:)(-]{0,25}$"
SENSITIVE = (
    r"\b(ombudsman|solicitor|lawyer|legal action|sue|court|trading standards|gdpr|data protection|journalist)\b",
    r"\b(assault\w*|harass\w*|abus\w*|threat\w*|unsafe|injur\w*|accident|emergency|police|ambulance|fainted|collapsed|stabb\w*|attack\w*)\b",
    r"\b(wheelchair|disabled|disability|accessib\w*|mobility assistance|vulnerable|pregnant|allerg\w*)\b",
    r"\b(discriminat\w*|racis\w*|sexis\w*|lost property|stolen|theft)\b",
    r"\b(complain\w*|compensat\w*|refund\w*|chargeback|fraud|scam)\b",
)
LINK_IN_REPLY, AMOUNT_IN_REPLY = r"https?://[^\s)\]>\"']+", r"£\s?\d[\d,]*(?:\.\d+)?"


def first_match(x: Column, rules, default: str) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(F.rlike(x, F.lit(pattern)), name)
    return out.otherwise(default)


def keyword_intent(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", "other").otherwise(first_match(X.matching_form(x), INTENTS, "other"))


def turn_signals(shown: Column, low: Column, other_operators: list[str] | Column = ()) -> Column:
    """Signals of one reply, in priority order: array<struct<signal, snippet>>.

    shown is its display text and low that in lower case, as columns of their own: every rule
    reads them, and the optimizer keeps a costly column that is read often as it is.
    """
    hit = {name: F.rlike(low, F.lit(p)) for name, p in SIGNALS.items()}
    hit["feedback_acknowledged"] = hit["feedback_acknowledged"] & ~hit["escalated"]
    handles = F.transform(X.mentions(shown), F.lower)
    known = other_operators if isinstance(other_operators, Column) else F.array(*[F.lit(h.lower()) for h in other_operators]).cast("array<string>")
    hit["redirected_to_other_operator"] = F.arrays_overlap(handles, known) & F.rlike(low, F.lit(OPERATOR_HANDOFF))
    strong = reduce(lambda a, b: a | b, [h for n, h in hit.items() if n != "clarification_requested"])
    words = F.size(F.filter(F.split(X.collapsed(F.regexp_replace(shown, X.URL, "")), " "), lambda w: w != ""))
    hit["information_provided"] = (words >= 6) & ~F.contains(shown, F.lit("?")) & ~strong
    hit["other"] = ~(strong | hit["clarification_requested"] | hit["information_provided"])
    whole = X.cut_with_ellipsis(shown, 220)
    quote = {**SIGNALS, "redirected_to_other_operator": OPERATOR_HANDOFF}
    return F.array_compact(F.array(*[F.when(hit[s], F.struct(F.lit(s).alias("signal"), (X.snippet(shown, quote[s]) if s in quote else whole).alias("snippet"))) for s in SIGNAL_PRIORITY]))


def outcome(last_role_is_customer: Column, has_agent: Column, customer: Column, agent: Column) -> Column:
    """How a thread ended, from who spoke last and the matching forms of the last text and the last agent's text."""
    asks = F.contains(agent, F.lit("?"))
    like = lambda x, p: F.rlike(x, F.lit(p))
    return (
        F.when(~has_agent, "no_response")
        .when(last_role_is_customer & like(customer, CONFIRMED) & ~like(customer, NEGATED), "customer_confirmed")
        .when(last_role_is_customer, "customer_followup_unanswered")
        .when(like(agent, CLOSING) & ~asks, "agent_closed")
        .when(like(agent, TO_DM), "redirected_to_dm")
        .when(like(agent, TO_CHANNEL), "redirected_to_channel")
        .when(asks, "agent_awaiting_customer")
        .otherwise("agent_answered_unconfirmed")
    )


def requested_items(x: Column) -> Column:
    low = X.collapsed(F.lower(F.coalesce(x, F.lit(""))))
    return F.array_compact(F.array(*[F.when(F.rlike(low, F.lit(REQUEST_CUE)) & F.rlike(low, F.lit(p)), F.lit(item)) for item, p in REQUESTS.items()]))


def evidence_quality(problem: Column, response: Column, n_brand: Column, kind: Column, intent: Column, continuation: Column, customer_first: Column, fallback: str = "unclear_or_media_only") -> Column:
    """struct<quality, reason>; an empty reason marks strong evidence."""
    words = lambda x: F.size(F.filter(F.split(X.collapsed(x), " "), lambda w: w != ""))
    say = lambda quality, reason: F.struct(F.lit(quality).alias("quality"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(n_brand == 0, say("no_brand_reply", "brand_never_replied"))
        .when(continuation | ~customer_first, say("weak", "continuation_without_opening_problem"))
        .when(intent.isNull(), say("weak", "no_candidate_intent"))
        .when(intent == fallback, say("weak", "fallback_intent_problem_unclear"))
        .when((words(problem) < 3) | F.rlike(F.coalesce(problem, F.lit("")), F.lit(THANKS_ONLY)), say("weak", "uninformative_customer_problem"))
        .when(kind.isin(*WEAK_TYPES), say("weak", F.concat(F.lit("weak_resolution_type_"), kind)))
        .when((words(X.strip_urls(response)) < 4) & ~F.rlike(response, F.lit(X.URL)), say("weak", "response_too_short"))
        .otherwise(say("strong", ""))
    )


def sensitive_words(x: Column) -> Column:
    """Distinct lower-case words that match a sensitive pattern, in pattern order."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"(?iU){p}"), F.lit(0)), F.lower) for p in SENSITIVE]
    return F.array_distinct(F.concat(*found))


def unsupported(reply: Column, source: Column) -> Column:
    """Links and amounts of a reply that its sources do not have."""
    link = lambda x: F.lower(F.regexp_replace(x, r"[.,;:!?]+$", ""))
    amount = lambda x: F.regexp_replace(x, r"[\s,]", "")
    every = lambda x, p: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(0))
    missing = lambda p, norm, said: F.transform(F.filter(every(reply, p), lambda u: ~F.array_contains(F.transform(every(source, p), norm), norm(u))), lambda u: F.concat(F.lit(said), u))
    return F.concat(missing(LINK_IN_REPLY, link, "link not found in the evidence: "), missing(AMOUNT_IN_REPLY, amount, "amount not found in the evidence: "))
