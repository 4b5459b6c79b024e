"""Operator 12, secret scans: trigram inverted index.

A Boolean query over trigrams is derived from the parse tree of each rule's regex: what any
text must hold for the regex to match (see ``trigram_query``). Texts are indexed in shards,
a batch of documents each: one pass over the shard's bytes, lower-cased A to Z, looks every trigram up in
a table of those that some rule asks for and writes the shard's posting lists (trigram to
sorted document numbers). Queries intersect and unite posting lists; only the candidates
left are verified with the regex. A rule without mandatory trigrams scans all of its shard.

A shard is built, asked and dropped in the task that holds its texts, so no text and no
posting is shuffled, and memory is bounded by the batch. The index is folded to lower case;
it may propose too much, never too little, so results do not depend on it.

Cases: null and empty texts have no spans; very long texts are one document of a shard like
any other; repeated rows are scanned each; empty tables give empty results. Columns of the
names made here are replaced, others pass through. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

# ---- rules: kind, regex (RE2 and Python alike), group that is measured, its least length. Fixed values; the first three are the base ----
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs [0-9a-f]+ of 32 and more
)
MORE = (
    ("temporary_access", r"ASIA[A-Z0-9]{16}", 0, 20),
    ("code_host", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 40),
    ("code_host_grant", r"github_pat_[A-Za-z0-9_]{40,}", 0, 40),
    ("code_host_personal", r"glpat-[A-Za-z0-9_-]{20,}", 0, 26),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("chat_hook", r"hooks\.slack\.com/services/[A-Za-z0-9_]+/[A-Za-z0-9_]+/[A-Za-z0-9_]+", 0, 40),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("payment", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("mail", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 69),
    ("package", r"npm_[A-Za-z0-9]{36}", 0, 40),
    ("package_index", r"pypi-AgEI[A-Za-z0-9_-]{50,}", 0, 59),
    ("storage", r"AccountKey=[A-Za-z0-9+/=]{60,}", 0, 70),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20),
    ("basic", r"(?i)authorization:\x20*basic\x20+([A-Za-z0-9+/=]{8,})", 1, 8),
    ("private_key", r"-----BEGIN ([A-Z0-9]+ ){0,3}PRIVATE KEY-----", 0, 27),
    ("address", r"(postgres|postgresql|mysql|mongodb|redis|amqp|https?|ftp)://[A-Za-z0-9._%+-]{1,64}:([^\x00-\x20/@:]{3,128})@[A-Za-z0-9.-]+", 2, 3),
)
RULES = BASE + MORE


# ---- from a regex to a Boolean query over trigrams ----
#
# A query is True (says nothing), a trigram (three lower-case bytes), or ("and" | "or", frozenset of queries).

#: Sets of literal strings are kept while they are as small as this; beyond, their trigrams are noted and they are forgotten.
MOST_STRINGS, MOST_LENGTH = 64, 40


def _all(queries) -> object:
    parts: set = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(queries) -> object:
    parts: set = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    asked = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in parts}
    parts = {q for q in parts if not any(asked[o] < asked[q] for o in parts)}  # what asks for more than another option adds nothing
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts)) if parts else True


def _holds(strings: set[bytes]) -> object:
    """One of the strings is in the text."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


class _Known:
    """What is known of the strings a piece of regex matches.

    whole: all of them, if they are few; else starts and ends have what they begin and end
    with (an empty string says nothing), and query what they hold.
    """

    def __init__(self, whole=None, starts=frozenset([b""]), ends=frozenset([b""]), query=True):
        self.whole, self.query = whole, query
        self.starts, self.ends = (whole, whole) if whole is not None else (starts, ends)

    def noted(self) -> "_Known":
        """Without whole, its trigrams noted."""
        if self.whole is None:
            return self
        cut = lambda side: frozenset(x[:2] if side else x[-2:] for x in self.whole)
        return _Known(None, cut(True), cut(False), _all([self.query, _holds(self.whole)]))


def _product(a, b) -> frozenset | None:
    if len(a) * len(b) > MOST_STRINGS:
        return None
    out = frozenset(x + y for x in a for y in b)
    return out if max(map(len, out), default=0) <= MOST_LENGTH else None


def _then(a: _Known, b: _Known) -> _Known:
    """a followed by b."""
    if a.whole is not None and b.whole is not None and (both := _product(a.whole, b.whole)) is not None:
        return _Known(both, query=_all([a.query, b.query]))
    across = _product(a.ends, b.starts)  # what stands where they meet
    met = _holds(across) if across is not None else True
    x, y = a.noted(), b.noted()
    starts = (_product(a.whole, b.starts) if a.whole is not None else None) or x.starts
    ends = (_product(a.ends, b.whole) if b.whole is not None else None) or y.ends
    return _Known(None, starts, ends, _all([x.query, y.query, met]))


def _either(options: list[_Known]) -> _Known:
    if all(o.whole is not None for o in options):
        whole = frozenset().union(*(o.whole for o in options))
        if len(whole) <= MOST_STRINGS:
            return _Known(whole, query=_any([o.query for o in options]))
    options = [o.noted() for o in options]
    side = lambda name: s if len(s := frozenset().union(*(getattr(o, name) for o in options))) <= MOST_STRINGS else frozenset([b""])
    return _Known(None, side("starts"), side("ends"), _any([o.query for o in options]))


def _folded(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass")


def _class(items) -> _Known:
    """A character class: its characters, if they are few."""
    found: set[bytes] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            found.add(_folded(arg))
        elif name == "RANGE" and arg[1] - arg[0] <= 2 * MOST_STRINGS:
            found |= {_folded(c) for c in range(arg[0], arg[1] + 1)}
        else:  # negated, a category or a long range
            return _Known()
        if len(found) > 16:
            return _Known()
    return _Known(frozenset(found))


def _known(tree) -> _Known:
    out = _Known(frozenset([b""]))
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            piece = _Known(frozenset([_folded(arg)]))
        elif name == "IN":
            piece = _class(arg)
        elif name == "SUBPATTERN":
            piece = _known(arg[-1])
        elif name == "ATOMIC_GROUP":
            piece = _known(arg)
        elif name == "BRANCH":
            piece = _either([_known(x) for x in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            one = _known(inner)
            if (least, most) == (0, 1):
                piece = _either([one, _Known(frozenset([b""]))])
            elif least == 0:
                piece = _Known()
            else:
                piece = one
                for _ in range(min(least, 4) - 1):
                    piece = _then(piece, one)
                if most != least or least > 4:  # more may follow: only the first ones are known
                    x = piece.noted()
                    piece = _Known(None, piece.starts, frozenset([b""]), x.query)
                    piece = _Known(None, piece.starts, one.ends, piece.query)
        elif name == "AT" or name in ("ASSERT", "ASSERT_NOT"):  # matches no character
            piece = _Known(frozenset([b""]))
        else:  # any character, a back reference, a category
            piece = _Known()
        out = _then(out, piece)
    return out


def trigram_query(pattern: str) -> object:
    """What every text that pattern matches in must hold: a Boolean query over lower-case trigrams, True if nothing."""
    return _known(_parser.parse(pattern)).noted().query


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


# ---- a shard ----

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slots:
    """Numbers of the trigrams that rules ask for; a table of 2^24 places tells one from the bytes at a place."""

    def __init__(self, trigrams: set[bytes]):
        self.names = sorted(trigrams)
        self.of = {t: i for i, t in enumerate(self.names)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.of.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i


def postings(texts: list[bytes], slots: Slots) -> dict[int, np.ndarray]:
    """Slot to the ascending numbers of the texts that hold its trigram, for the shard of these texts."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if len(buf) < 3 or not slots.names:
        return {}
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(lens) - lens
    low = _LOWER[buf].astype(np.int32)
    slot = slots.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
    at = np.flatnonzero(slot >= 0)  # a trigram over the end of a text holds a line end; it proposes too much at most
    pair = np.unique(slot[at].astype(np.int64) * len(texts) + np.searchsorted(begin, at, "right") - 1)
    which, doc = pair // len(texts), pair % len(texts)
    each, first = np.unique(which, return_index=True)
    return dict(zip(each.tolist(), np.split(doc, first[1:]))) if len(pair) else {}


def candidates(query: object, index: dict[int, np.ndarray], slots: Slots, size: int) -> np.ndarray:
    """Numbers of the shard's texts that satisfy the query; all if it says nothing."""
    none = np.zeros(0, np.int64)
    if query is True:
        return np.arange(size)
    if isinstance(query, bytes):
        return index.get(slots.of[query], none)
    found = sorted((candidates(q, index, slots, size) for q in query[1]), key=len)
    out = found[0]
    for other in found[1:]:
        out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        if query[0] == "and" and not len(out):
            break
    return out


class Scanner:
    """Rules with their trigram queries. Compiled where it is used; what is sent to tasks is the rules."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern, re.ASCII), trigram_query(pattern), group, least) for kind, pattern, group, least in rules]
        self.slots = Slots(set().union(*(trigrams_of(r[2]) for r in self.rules)))

    def scan(self, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], int]:
        """(start, rule, end) of each text, sorted; and how many texts were verified, over all rules."""
        index = postings([t.encode("utf-8", "surrogatepass") for t in texts], self.slots)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        verified = 0
        for number, (_, regex, query, group, least) in enumerate(self.rules):
            for i in candidates(query, index, self.slots, len(texts)).tolist():
                verified += 1
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out, verified


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def found(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with an array secrets of (kind, start, end), by start, then in the order of the rules."""
    return B.shielded(docs, ("text",), ("secrets",), lambda d: _found(d, tuple(rules)))


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(rules: tuple) -> Scanner:
    """One a worker; other rules replace it."""
    if rules not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _found(docs: DataFrame, rules: tuple) -> DataFrame:
    B.ready(docs.sparkSession)
    frame = docs.select(*docs.columns, F.col("text").cast("string").alias("_text"))
    kinds = [r[0] for r in rules]

    def run(batches):
        scanner = _scanner(rules)
        for b in batches:
            spans, _ = scanner.scan([t or "" for t in b.column("_text").to_pylist()])
            b = b.drop_columns(["_text"])
            got = pa.array([[{"kind": kinds[n], "start": s, "end": e} for s, n, e in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "secrets"])

    return frame.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("secrets", SPAN)]))


def _written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id with counts of the base kinds, the digest of the base spans, and all spans as text; from found()."""
    base = [kind for kind, *_ in BASE]
    is_base = lambda s: s["kind"].isin(base)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    n = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *n, F.sha2(text(F.filter("secrets", is_base)).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def redacted(scanned: DataFrame, mask: str = "[secret]") -> DataFrame:
    """found() with each run of overlapping spans in text replaced by mask."""
    end = F.coalesce(F.array_max(F.transform("secrets", lambda s: s["end"])), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    done = F.aggregate("secrets", start, step, lambda acc: acc["out"])
    return scanned.withColumn("text", F.when(F.size("secrets") > 0, F.concat(done, F.substring("text", (end + 1).cast("int"), F.char_length("text")))).otherwise(F.col("text")))


def _sql() -> str:
    """Every rule over every text; places follow from the lengths of the matches and of what lies between them."""
    rows = []
    for number, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        rows.append(
            f"SELECT doc_id, {number} AS rule, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, list_transform(m, lambda x: length(x)) AS n, list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x)) AS gaps, g, {least} AS least "
            f"FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g FROM d) WHERE len(m) > 0"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS ({' UNION ALL '.join(rows)}),
s AS (SELECT doc_id, rule, kind, (coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(n[1:i - 1]), 0))::BIGINT AS start, n[i] AS n FROM r WHERE length(g[i]) >= least),
t AS (SELECT doc_id, rule, kind, start, concat(kind, ':', start, ':', start + n) AS span FROM s)
SELECT doc_id, count(rule) FILTER (kind = 'assign') AS n_assign, count(rule) FILTER (kind = 'access') AS n_access, count(rule) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id"""


ORACLE = _sql()
