"""Operator 7, quality rules: thresholds from mergeable quantile sketches.

One pass measures each text. A sketch of each measure per (lang, source) counts values in
buckets of 1 % relative width (a DDSketch): sketches merge by adding counts, in any order,
with the same result each time. Every fence is read off the sketches:

* the upper fence of a measure is the third quartile and ``SPREAD`` quartile distances, or the
  ``HIGH`` quantile, or ``TYPICAL`` times the median of the values above zero, whichever is
  most. Where most documents have nothing of a measure both quartiles are zero and the quantile
  decides: where more than one in ten documents has symbols the usual ones of them stay,
  where fewer have any they are the odd ones out and go,
* word length also has a lower fence, below the first quartile.

A group's quantiles are drawn towards those of its language, and these to those of all
documents, with the weight of ``PRIOR`` documents, so a small group has fences of its own and
yet no wild ones; a sketch without values adds nothing. ``LEAST`` is what a measure may always
have (one symbol in a hundred characters is never unusual). Fences are joined to the
documents; their table is broadcast only after its size is checked.

Cases: null text counts as no words and fails the base rule, as do empty texts; null lang
or source is a group of its own; repeated rows are judged alike. Empty tables give empty
results; other columns pass through, columns of the names made here are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import words as W

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Documents as many as which a wider group's quantiles weigh.
PRIOR = 20.0
#: Relative error of a sketch's quantiles.
ERROR = 0.01
#: Quartile distances beyond the quartiles.
SPREAD = 8.0
#: No fence lies below this quantile of its group: what a group has more often is not unusual there.
HIGH = 0.9
#: Times the median of what lies above zero, for measures of repetition, which every kind of text has at times.
TYPICAL = {"dup_line_share": 3.0, "repeat_share": 4.0}
#: Least upper fence, and least distance of the word length's fences from its quartiles.
LEAST = {"symbol_share": 0.01, "dup_line_share": 0.1, "repeat_share": 0.05, "word_length": 0.5}
LOWER = ("word_length",)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def measure(texts: list[bytes], window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    buf, at = W.joined(texts)
    ends = np.append(at[1:], len(buf))
    start, end = W.spans(buf)
    doc = np.searchsorted(at, start, "right") - 1
    out = {"n_words": np.bincount(doc, minlength=len(texts))}
    within = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[ends] - c[at]
    out["word_chars"] = within(_STARTS_CHAR[buf] & ~W.SPACE[buf])
    out["n_symbols"] = within(_SYMBOL[buf])
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    covered = np.zeros(len(start) + 1, np.int64)
    if len(start) >= window:
        key = W.run_hashes(W.hashes(buf, start, end), window)
        same = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])
        key = W.mix(key[same] ^ W.mix(doc[same].astype(np.uint64)))  # equal only within a text
        order = np.argsort(key)
        twin = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][twin]] = again[order[:-1][twin]] = True
        covered[same[again]] += 1
        covered[same[again] + window] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=len(texts))
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with COUNTS, in one pass without a shuffle."""
    return B.shielded(docs, ("text", "lang", "source"), COUNTS, _with_counts)


def _with_counts(docs: DataFrame) -> DataFrame:
    B.ready(docs.sparkSession)
    frame = docs.select(*docs.columns, F.col("text").cast("string").cast("binary").alias("_body"))

    def run(batches):
        for b in batches:
            got = measure([x or b"" for x in b.column("_body").to_pylist()])
            b = b.drop_columns(["_body"])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(got[c]) for c in COUNTS]], names=[*b.schema.names, *COUNTS])

    return frame.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def measures() -> dict[str, Column]:
    return {"symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words"), "word_length": _share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _group(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def thresholds(counted: DataFrame) -> DataFrame:
    """lang_key, source_key and a fence for each measure; one row a group."""
    gamma = (1 + ERROR) / (1 - ERROR)
    bucket = F.when(F.col("value") > 1e-9, F.ceil(F.ln("value") / F.lit(float(np.log(gamma)))).cast("int"))
    values = F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("value")) for m, c in measures().items()])
    long = counted.where(~base_failed()).select(_group("lang").alias("lang_key"), _group("source").alias("source_key"), F.explode(values).alias("x")).select("lang_key", "source_key", "x.measure", "x.value")
    fine = B.saved(long.withColumn("bucket", bucket).groupBy("lang_key", "source_key", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        """Of the sketches merged by keys. A sketch has a bounded number of buckets, so these windows are over few rows."""
        w = Window.partitionBy(*keys, "measure")
        up = w.orderBy(F.asc_nulls_first("bucket"))
        some = F.when(F.col("bucket").isNotNull(), F.col("n"))
        merged = fine.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket").cast("double")) / (gamma + 1))
        run = merged.select(*keys, "measure", value.alias("value"), F.sum("n").over(w).alias("n"), F.sum("n").over(up).alias("upto"), F.coalesce(F.sum(some).over(w), F.lit(0)).alias("pos"), F.coalesce(F.sum(some).over(up), F.lit(0)).alias("pos_upto"))
        at = lambda p: F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("value")))
        half = F.min(F.when((F.col("pos_upto") > 0) & (F.col("pos_upto") >= F.col("pos") * 0.5), F.col("value")))
        return run.groupBy(*keys, "measure").agg(F.struct(F.max("n").cast("double").alias("n"), F.max("pos").cast("double").alias("pos"), at(0.25).alias("q1"), at(0.75).alias("q3"), at(HIGH).alias("top"), F.coalesce(half, F.lit(0.0)).alias("mid")).alias(tag))

    drawn = lambda own, n, wide: (n * own + PRIOR * wide) / (n + PRIOR)
    per = quantiles(["lang_key", "source_key"], "own").join(quantiles(["lang_key"], "wide"), ["lang_key", "measure"]).join(quantiles([], "whole"), "measure")
    for q, n in (("q1", "n"), ("q3", "n"), ("top", "n"), ("mid", "pos")):
        per = per.withColumn(q, drawn(F.col(f"own.{q}"), F.col(f"own.{n}"), drawn(F.col(f"wide.{q}"), F.col(f"wide.{n}"), F.col(f"whole.{q}"))))
    fence = []
    reach = SPREAD * (F.col("q3") - F.col("q1"))
    for m, least in LEAST.items():
        high = F.greatest(F.col("q3") + reach, F.col("top"), TYPICAL.get(m, 0.0) * F.col("mid"), F.lit(least) + (F.col("q3") if m in LOWER else 0.0))
        fence.append(F.max(F.when(F.col("measure") == m, high)).alias(f"max_{m}"))
        if m in LOWER:
            fence.append(F.max(F.when(F.col("measure") == m, F.col("q1") - F.greatest(reach, F.lit(least)))).alias(f"min_{m}"))
    return per.groupBy("lang_key", "source_key").agg(*fence)


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted (from with_counts) with base_failed and kept."""
    names = [f.name for f in limits.schema if f.name not in ("lang_key", "source_key")]
    limits = B.checked_side(limits.select(F.col("lang_key").alias("_l"), F.col("source_key").alias("_s"), *[F.col(n).alias(f"_{n}") for n in names]))
    ok = F.lit(True)
    for m, c in measures().items():
        for side, wrong in (("max", lambda a, b: a > b), ("min", lambda a, b: a < b)):
            if f"{side}_{m}" in names:
                ok = ok & ~F.coalesce(wrong(c, F.col(f"_{side}_{m}")), F.lit(False))

    def run(docs: DataFrame) -> DataFrame:
        joined = docs.join(limits, (_group("lang") == F.col("_l")) & (_group("source") == F.col("_s")), "left")
        return joined.select(*docs.columns, base_failed().alias("base_failed"), (~base_failed() & ok).alias("kept"))

    return B.shielded(counted, ("lang", "source", *COUNTS), ("base_failed", "kept"), run)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with COUNTS, base_failed and kept. Texts are measured twice rather than shuffled."""
    return judged(with_counts(docs), thresholds(with_counts(docs.select("text", "lang", "source")).drop("text")))


def _sql() -> str:
    """The query's result in SQL, for documents with distinct ids."""
    gamma = float((1 + ERROR) / (1 - ERROR))
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    made = {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {c} AS value FROM b WHERE NOT base_failed" for m, c in made.items())
    parts = []
    for tag, keys in {"own": "lang, source, ", "wide": "lang, ", "whole": ""}.items():
        over = f"PARTITION BY {keys}measure"
        parts.append(
            f"{tag} AS (SELECT {keys}measure, max(n)::DOUBLE AS n, max(pos)::DOUBLE AS pos, min(CASE WHEN upto >= n * 0.25 THEN v END) AS q1, min(CASE WHEN upto >= n * 0.75 THEN v END) AS q3, min(CASE WHEN upto >= n * {HIGH} THEN v END) AS top, coalesce(min(CASE WHEN pos_upto > 0 AND pos_upto >= pos * 0.5 THEN v END), 0.0) AS mid FROM "
            f"(SELECT {keys}measure, CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * pow({gamma!r}, bucket) / ({gamma!r} + 1) END AS v, sum(n) OVER ({over}) AS n, sum(n) OVER ({over} ORDER BY bucket NULLS FIRST) AS upto, "
            f"coalesce(sum(CASE WHEN bucket IS NOT NULL THEN n END) OVER ({over}), 0) AS pos, coalesce(sum(CASE WHEN bucket IS NOT NULL THEN n END) OVER ({over} ORDER BY bucket NULLS FIRST), 0) AS pos_upto FROM "
            f"(SELECT {keys}measure, bucket, sum(n) AS n FROM cells GROUP BY {keys}measure, bucket)) GROUP BY {keys}measure)"
        )
    drawn = lambda own, n, wide: f"(({n} * {own} + {PRIOR} * {wide}) / ({n} + {PRIOR}))"
    pick = lambda q, n: drawn(f"o.{q}", f"o.{n}", drawn(f"w.{q}", f"w.{n}", f"a.{q}"))
    high = lambda m: f"value > greatest(q3 + {SPREAD} * (q3 - q1), top, {TYPICAL.get(m, 0.0)} * mid, {LEAST[m]} + {'q3' if m in LOWER else '0.0'})"
    wrong = [f"(measure = '{m}' AND ({high(m)}" + (f" OR value < q1 - greatest({SPREAD} * (q3 - q1), {LEAST[m]})" if m in LOWER else "") + "))" for m in LEAST]
    return (
        r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
"""
        + f"l AS ({long}), cells AS (SELECT lang, source, measure, CASE WHEN value > 1e-9 THEN ceil(ln(value) / {float(np.log(gamma))!r})::INTEGER END AS bucket, count(*) AS n FROM l GROUP BY ALL), "
        + ", ".join(parts)
        + f""", q AS (SELECT o.lang, o.source, o.measure, {pick('q1', 'n')} AS q1, {pick('q3', 'n')} AS q3, {pick('top', 'n')} AS top, {pick('mid', 'pos')} AS mid FROM own o JOIN wide w ON w.measure = o.measure AND w.lang IS NOT DISTINCT FROM o.lang JOIN whole a ON a.measure = o.measure),
bad AS (SELECT DISTINCT doc_id FROM l JOIN q ON q.measure = l.measure AND q.lang IS NOT DISTINCT FROM l.lang AND q.source IS NOT DISTINCT FROM l.source WHERE {' OR '.join(wrong).replace('measure =', 'l.measure =')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""
    )


ORACLE = _sql()
