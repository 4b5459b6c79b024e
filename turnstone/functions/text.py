"""Text expressions: normalisation, keys, masks, tokens. All are Columns; none runs Python.

Regexes are Java's. ``(?U)`` makes \\w, \\b and \\d cover Unicode where that is meant.
"""

from __future__ import annotations

import hashlib
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, placeholders and lists that define the results ----
MENTION = r"(?U)@\w+"
URL = r"https?://\S+"
SIGNATURE = r"(?:\s|(?<=[.!?)]))[\^\-–—~*]\s*[A-Z][A-Za-z]{0,11}\.?\s*$"
LEADING_MENTIONS = r"(?U)^(?:\s*@\w+)+\s*"
SIGN_OFF = r"\s*\^[A-Za-z]{2,3}\s*$"
PART_MARKER = r"^\s*\d+/\d+\s*"
MONEY = r"£\s?\d[\d,.]*"
TIME = r"\b\d{1,2}[:.]?\d{2}\s?(?:am|pm)?\b|\b\d{1,2}\s?(?:am|pm)\b"
SEAT = r"\b(?:coach|carriage|seat|platform|row|table)\s+[a-z]?\d*[a-z]?\b"
DAY = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b"
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Runs of what is no small letter, digit or space; as plain ranges it takes a small part of the time of a negated class.
OTHER = r"[\x00-\x1f!-/:-`{-\x{10ffff}]+"
#: What browsers read the numbers 128 to 159 as.
WINDOWS = bytes(range(128, 160)).decode("cp1252", "replace")
KEPT_NEGATIONS = ("no", "not", "nor", "never", "cannot", "nothing", "without", "none")
#: Our own short place lexicon; behaviour (longest name first) matters, not the names.
PLACES = ("milton keynes", "birmingham", "manchester", "edinburgh", "liverpool", "glasgow", "london", "preston", "crewe", "york")
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself just me more most my of off on once only or other our ours out over own same she so some "
    "such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _named(entity: Column) -> Column:
    """A named reference (without &): its characters, else the longest known start of it and the rest, else itself."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # the standard's own list, folded to a constant
    size = F.char_length(entity)
    start = lambda n: F.substring(entity, F.lit(1), n)
    known = F.filter(F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.try_element_at(table, start(n)).alias("x"))), lambda k: k["x"].isNotNull())
    best = F.get(known, F.lit(0))
    return F.when(best.isNotNull(), F.concat(best["x"], F.substring(entity, best["n"] + 1, size))).otherwise(F.concat(F.lit("&"), entity))


def _numbered(reference: Column) -> Column:
    """The character of a reference like #65; or #x41; (the number in decimal or hexadecimal digits)."""
    digits = F.regexp_replace(reference, "[#;]", "")
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    code = F.when(F.char_length(digits) > 9, F.lit(1 << 30)).when(is_hex, F.conv(F.substring(digits, 2, 9), 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
    one = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    windows = F.substring(F.lit(WINDOWS), (code - 127).cast("int"), F.lit(1))
    odd = F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(code.between(128, 159), F.when(windows != "\ufffd", windows).otherwise(one)).when(dropped, "")
    return F.coalesce(odd, one)


def unescaped(x: Column) -> Column:
    """HTML character references replaced: all named ones, with or without their semicolon as the standard lists them, and numeric ones."""
    x = F.coalesce(x, F.lit(""))
    found, between = F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(1)), F.split(x, REFERENCE, -1)
    plain = F.transform(found, lambda e: F.when(e.startswith("#"), _numbered(e)).otherwise(_named(e)))
    whole = F.array_join(F.zip_with(between, plain, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(x, F.lit("&")), whole).otherwise(x)


def strip_mentions(x: Column) -> Column:
    return collapsed(F.regexp_replace(x, MENTION, " "))


def strip_urls(x: Column) -> Column:
    return collapsed(F.regexp_replace(x, URL, " "))


def matching_form(x: Column) -> Column:
    """Lower case, without mentions and sign-off, links masked, white space collapsed."""
    x = F.regexp_replace(unescaped(x), SIGNATURE, "")
    x = F.regexp_replace(F.regexp_replace(x, MENTION, " "), URL, " <url> ")
    return collapsed(F.replace(F.lower(x), F.lit("’"), F.lit("'")))


def first_tokens(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(x, " "), lambda t: t != ""), 1, n), " ")


def template_key(x: Column, n_tokens: int = 8) -> Column:
    x = F.regexp_replace(matching_form(x), r"(?U)\d+", "0")
    return first_tokens(collapsed(F.regexp_replace(x, r"[^a-z0-9<>' ]+", " ")), n_tokens)


def latin_share(x: Column) -> Column:
    """ASCII letters over all letters; 1 if there are none."""
    x = strip_mentions(F.regexp_replace(F.coalesce(x, F.lit("")), URL, " "))
    letters = F.char_length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.when(letters == 0, 1.0).otherwise(F.char_length(F.regexp_replace(x, "[^A-Za-z]", "")) / letters)


def display_text(x: Column) -> Column:
    for pattern in (SIGN_OFF, LEADING_MENTIONS, PART_MARKER):
        x = F.regexp_replace(unescaped(x) if pattern == SIGN_OFF else x, pattern, "")
    return collapsed(x)


def cut_with_ellipsis(x: Column, limit: int) -> Column:
    return F.when(F.char_length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - 1), F.lit("…")))


def snippet(display: Column, pattern: str, limit: int = 220) -> Column:
    """The first sentence whose lower case matches, else the whole text; cut at limit."""
    hits = F.filter(F.split(display, r"(?<=[.!?])\s+"), lambda s: F.rlike(F.lower(s), F.lit(pattern)))
    return cut_with_ellipsis(F.coalesce(F.get(hits, F.lit(0)), display), limit)


def clip(x: Column, limit: int) -> Column:
    """Cut at a word boundary in the second half if there is one, with an ellipsis."""
    x = F.trim(x)
    head = F.substring(x, 1, limit - 1)
    word = F.regexp_replace(head, r" [^ ]*$", "")
    in_second_half = F.instr(F.substring(head, limit // 2 + 1, limit), " ") > 0
    cut = F.regexp_replace(F.when(in_second_half, word).otherwise(head), r"[ ,;:\-]+$", "")
    return F.when(F.char_length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def opener_key(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), URL, " "), MENTION, " ")
    return collapsed(F.regexp_replace(F.regexp_replace(x, r"(?U)\d+", "0"), OTHER, " "))


def opener_digest(x: Column) -> Column:
    """SHA-256 of opener_key, to compare long texts by; empty for an empty key."""
    return F.replace(F.sha2(opener_key(x), 256), F.lit(hashlib.sha256(b"").hexdigest()), F.lit(""))


def mask_entities(x: Column, places: tuple[str, ...] = PLACES) -> Column:
    """Money, times, seats, days and places become placeholders, in that order; x is lower case."""
    longest_first = "|".join(sorted(places, key=lambda p: (-len(p), p)))
    for pattern, name in ((MONEY, "money"), (TIME, "time"), (SEAT, "seat"), (DAY, "day"), (rf"\b(?:{longest_first})\b", "place")):
        x = F.regexp_replace(x, pattern, f" <{name}> ")
    return collapsed(x)


def opening_form(x: Column, mask: bool = True) -> Column:
    x = F.replace(unescaped(x), F.lit("’"), F.lit("'"))
    x = F.regexp_replace(F.regexp_replace(x, URL, " "), MENTION, " ")
    x = F.lower(F.regexp_replace(x, r"(?U)#(\w+)", " $1 "))
    x = F.regexp_replace(mask_entities(x) if mask else x, r"(?U)\d+", "0")
    return collapsed(F.regexp_replace(x, "[^a-z0-9<>' ]+", " "))


def informative(opening: Column, min_tokens: int = 3) -> Column:
    words = F.filter(F.split(opening, " "), lambda w: (w != "") & ~w.startswith("<") & ~F.rlike(w, F.lit("^[0-9]+$")))
    return F.size(words) >= min_tokens


def _spread(x: Column) -> Column:
    marked = F.contains(x, F.lit("&")) | F.contains(x, F.lit("@")) | F.contains(x, F.lit("#")) | F.contains(x, F.lit("://"))
    straight = lambda t: F.replace(t, F.lit("’"), F.lit("'"))
    free = F.regexp_replace(F.regexp_replace(straight(unescaped(x)), URL, " "), MENTION, " ")
    return F.when(~marked, straight(x)).otherwise(F.regexp_replace(free, r"(?U)#(\w+)", " $1 "))  # most texts need no regex


def indexed_text(x: Column) -> Column:
    """For retrieval: unescaped, without links and mentions, hashtag words kept."""
    return collapsed(_spread(x))


def stem(t: Column) -> Column:
    n = F.char_length(t)
    kept = ~t.endswith("s") | t.endswith("ss") | t.endswith("us") | t.endswith("is")  # most words: asked first, without their length
    return F.when(kept, t).when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when(n > 3, F.substring(t, F.lit(1), n - 1)).otherwise(t)


def tokens(x: Column) -> Column:
    """Index terms: words without stop words (negations stay), stemmed."""
    low = F.replace(F.lower(_spread(x)), F.lit("'"), F.lit(""))  # white space parts words, however much of it
    words = F.regexp_extract_all(low, F.lit("[a-z0-9£]+"), F.lit(0))
    return F.transform(F.filter(words, lambda t: ~t.isin(*STOP_WORDS)), stem)


def mentions(x: Column, digits: bool = False) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"@(\d+)" if digits else r"(?U)@(\w+)"), F.lit(1))


def placeholders(x: Column) -> Column:
    """Links and handles become words, for bag-of-words models."""
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(unescaped(x)), URL, " urltoken "), MENTION, " handletoken "))


def count_words(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)https?://\S+|[@#]\w+", " ")
    return F.size(F.regexp_extract_all(x, F.lit("[A-Za-z0-9£']+"), F.lit(0)))


def render_turns(turns: Column) -> Column:
    """"[ROLE id] text" lines of array<struct<id, role, text>>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), F.upper(t["role"]), F.lit(" "), t["id"].cast("string"), F.lit("] "), t["text"])), "\n")


def parsed_turns(rendered: Column) -> Column:
    """The inverse of render_turns; lines without a header continue the turn above."""
    parts = F.filter(F.split(rendered, r"(?m)^(?=\[[A-Z_]+ \d+\] )"), lambda p: p != "")
    head = r"(?s)^\[([A-Z_]+) (\d+)\] (.*?)\n?$"
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, head, 2).cast("long").alias("id"), F.lower(F.regexp_extract(p, head, 1)).alias("role"), F.regexp_extract(p, head, 3).alias("text")))
