"""Dates, hashes, numbers, arrays and JSON as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
LENGTHS = ((2, "short_1-2"), (4, "medium_3-4"), (8, "long_5-8"), (None, "very_long_9+"))
FIRST_WEEK = "2017-10-09"


def created_at(x: Column) -> Column:
    """"Tue Oct 31 22:10:47 +0000 2017" as a timestamp, by its own offset; else null."""
    shape = r"^[A-Za-z]{3} ([A-Za-z]{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}) (\d{4})$"
    x = F.trim(x)
    part = lambda i: F.regexp_extract(x, shape, i)
    rebuilt = F.concat(F.lpad(part(2), 2, "0"), F.lit(" "), part(1), F.lit(" "), part(5), F.lit(" "), part(3), F.lit(" "), part(4))
    return F.when(F.rlike(x, F.lit(shape)), F.try_to_timestamp(rebuilt, F.lit("dd MMM yyyy HH:mm:ss Z")))


def whole_number(x: Column) -> Column:
    """An id in text: trims, takes "12.0", rejects fractions and words; exact above 2**53."""
    x = F.trim(x)
    return F.when(F.rlike(x, F.lit(r"^[+-]?\d+(\.0*)?$")), F.regexp_replace(x, r"\.0*$", "").try_cast("long"))


def id_list(x: Column) -> Column:
    """A comma list of ids; blanks are skipped, one bad element empties the list."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), F.trim), lambda e: e != "")
    return F.when(F.exists(parts, lambda e: whole_number(e).isNull()), F.array().cast("array<bigint>")).otherwise(F.transform(parts, whole_number))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 6e7


def week_label(ts: Column, first: str = FIRST_WEEK) -> Column:
    return F.when(ts.isNull(), "unknown_time").when(ts < F.lit(first).cast("timestamp"), f"before_{first}").otherwise(F.concat(F.lit("week_"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")))


def length_label(turns: Column) -> Column:
    return F.when(turns < 0, "unknown").when(turns <= 2, LENGTHS[0][1]).when(turns <= 4, LENGTHS[1][1]).when(turns <= 8, LENGTHS[2][1]).otherwise(LENGTHS[3][1])


def query_length_label(tokens: Column) -> Column:
    return F.when(tokens <= 5, "short_1-5").when(tokens <= 12, "medium_6-12").otherwise("long_13+")


def hash_fraction(x: Column, digits: int = 12, closed: bool = False) -> Column:
    """The first hex digits of SHA-256 as a fraction in [0, 1), or [0, 1] if closed."""
    top = float(16**digits - (1 if closed else 0))
    return F.conv(F.substring(F.sha2(x, 256), 1, digits), 16, 10).cast("double") / F.lit(top)


def seeded(seed: int, x: Column) -> Column:
    return F.concat(F.lit(f"{seed}:"), x.cast("string"))


def fingerprint(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ids, one a line. For lists of a size the caller bounds."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "\n"), 256)


def confidence(x: Column) -> Column:
    """"80%", 80 and 0.8 are 0.8; clamped to 0..1; words, NaN and null give null."""
    text = F.trim(x.cast("string"))
    n = F.regexp_replace(text, "%$", "").try_cast("double")
    n = F.when(text.endswith("%") | (n > 1), n / 100).otherwise(n)
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def verifier_confidence(x: Column) -> Column:
    n = F.trim(x.cast("string")).try_cast("double")
    n = F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def label(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^[\"'`]+|[\"'`]+$", ""), r"[\s-]+", "_")


def boolean(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def json_object(x: Column) -> Column:
    """The outermost {...} of a text (fenced or in prose), if it is valid JSON; else null."""
    body = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.get_json_object(body, "$").isNotNull(), body)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / scale)), F.when(n > 0, F.least(F.lit(1.0), (centre + spread) / scale))


def half_even(x: Column, digits: int) -> Column:
    """Rounded to digits, ties to the even neighbour, as Python's round does."""
    return F.bround(x, digits)
