"""Operator 2, substring dedup: suffix automata of reference shards.

A window is ``length`` consecutive words. Every word covered by a window whose words also
start earlier (smaller doc_id, or same document and earlier start) is removed.

The reference is the corpus itself, so it has no proven size bound and is not broadcast
whole. It is cut into shards that hold all passages of one *anchor*: the smallest hash of
the 10-word runs in a window. Equal windows have equal anchors, so a shard never needs
another one. Three passes over blocks of documents (see ``blocks``):

1. anchors of each block go to buckets, which answer which of them occur more than once,
2. windows under repeated anchors, in runs that share an anchor occurrence, go to their
   shard as words. In document order, each passage is streamed through the suffix automaton
   of the shard's earlier passages; where its matching statistic reaches ``length``, the
   window is a repeat. Hashes only propose: the words decide,
3. each block removes its maximal repeated spans.

A passage that many documents share is combined in each block first. An anchor with very
many occurrences (``HOT``) is a hot key: it is split by a second one, the hash of the whole
window, so its passages of one window each spread over as many shards, judged as any other,
and no shard grows with the corpus.

Cases: null text: no words (kept text null); empty text: no words; null doc_id: after all
others; rows that share a doc_id: in the order of the table's rows; short texts: kept whole. Empty
tables give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import words as W

#: Occurrences of an anchor beyond which each of its windows has a shard of its own.
HOT = 2_000
_STEP = 1 << 21
_NULL_ID = np.iinfo(np.int64).max


class SuffixAutomaton:
    """Generalised suffix automaton over words; passages are added one after another."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def _split(self, p: int, q: int, word) -> int:
        """A copy of q for the strings up to len(p) + 1; links to q from p upwards move to it."""
        copy = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, passage: list) -> None:
        last = 0
        for word in passage:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, q, word)
                continue
            new, p = len(self.len), last
            self.next.append({})
            self.link.append(0)
            self.len.append(self.len[last] + 1)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, word)
            last = new

    def statistics(self, passage: list) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        state, matched, out = 0, 0, []
        for word in passage:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            out.append(matched)
        return out


class _Block:
    """The words of a block's documents, and its windows in runs of one anchor occurrence."""

    def __init__(self, table: pa.Table, length: int) -> None:
        self.ids, self.row, self.texts, self.rows = B.documents_of(table)
        self.length, k = length, max(1, length // 2)
        self.norm = [b" ".join((t or b"").split()) for t in self.texts]
        self.n_words = np.array([t.count(b" ") + 1 if t else 0 for t in self.norm], np.int64)
        self.first = np.cumsum(self.n_words) - self.n_words
        self.start, self.end, h = [], [], []
        self.buf, _ = W.joined(self.norm)
        begin = i = 0
        while i < len(self.norm):  # hash about a megabyte at a time
            j, size = i, 0
            while j < len(self.norm) and (size < 1 << 20 or j == i):
                size += len(self.norm[j]) + 1
                j += 1
            part = self.buf[begin : begin + size]
            s, e = W.spans(part)
            h.append(W.hashes(part, s, e))
            self.start.append(s + begin)
            self.end.append(e + begin)
            begin, i = begin + size, j
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, h = cat(self.start, np.int64), cat(self.end, np.int64), cat(h, np.uint64)
        doc = np.repeat(np.arange(len(self.norm)), self.n_words)
        self.doc = doc
        at, value = [], []
        grams = W.run_hashes(h, k)
        for lo in range(0, max(0, len(h) - length + 1), _STEP):
            hi = min(len(h) - length + 1, lo + _STEP)
            g = grams[lo : hi + length - k]
            low = np.uint64(0xFFFFFF)  # the leftmost of the smallest: place in the low bits
            key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
            best, n, out, done = key, 1, None, 0
            w = length - k + 1
            while True:  # minimum over w consecutive keys, by doubling
                if w & n:
                    out, done = (best, n) if out is None else (np.minimum(out[: len(key) - done - n + 1], best[done : done + len(key) - done - n + 1]), done + n)
                if done == w:
                    break
                best = np.minimum(best[:-n], best[n:])
                n *= 2
            least = (out & low).astype(np.int64)
            ok = doc[lo:hi] == doc[lo + length - 1 : hi + length - 1]
            at.append(np.where(ok, least + lo, -1))
        at = cat(at, np.int64)
        change = np.flatnonzero(np.diff(at, prepend=-2))
        stop = np.append(change[1:], len(at))
        good = at[change] >= 0
        self.run, self.stop = change[good], stop[good]  # windows run[i] .. stop[i] - 1
        self.anchor = grams[at[self.run]] if len(self.run) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.anchor, return_inverse=True, return_counts=True)

    def passages(self, status: np.ndarray) -> list[tuple[int, int, int]]:
        """Anchor (or window hash), first window and end window of what is sent to shards."""
        kind = status[self.anchors()[1]] if len(self.anchor) else np.zeros(0, np.uint8)
        out = [(int(self.anchor[i]), int(self.run[i]), int(self.stop[i])) for i in np.flatnonzero(kind == 1)]
        for i in np.flatnonzero(kind == 2):
            for w in range(self.run[i], self.stop[i]):
                out.append((int.from_bytes(hashlib.blake2b(self.words(w, w + 1), digest_size=8).digest(), "little"), w, w + 1))
        return out

    def words(self, window: int, stop: int) -> bytes:
        return self.buf[self.start[window] : self.end[stop + self.length - 2]].tobytes()

    def distinct(self, status: np.ndarray) -> dict[tuple[int, bytes], list[tuple[int, int]]]:
        """Windows at which each different passage is, by group and words; the first one first."""
        out: dict = {}
        for group, w, stop in sorted(self.passages(status), key=lambda x: x[1]):
            out.setdefault((group, self.words(w, stop)), []).append((w, stop))
        return out


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(values) % np.uint64(n)).astype(np.int64)


def _status(block: _Block, replies: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    values, answers = block.anchors()[0], dict(replies)
    status = np.zeros(len(values), np.uint8)
    for bucket, at in B.by_bucket(_bucket(values, buckets)):
        status[at] = np.frombuffer(answers[bucket], np.uint8)
    return status


_Z = lambda: zstandard.ZstdCompressor(level=1)


def remove_repeats(docs: DataFrame, *, length: int = 20, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """docs with words of repeated windows taken out of text, and n_words, n_removed, kept_sha256.

    A text that loses words becomes its kept words joined by one space; others stay as they are.
    The columns n_words, n_removed and kept_sha256 are new; columns of those names are replaced.
    """
    if not {"doc_id", "text"} <= set(docs.columns):
        raise ValueError("documents need doc_id and text")
    return B.shielded(docs, ("doc_id", "text"), ("n_words", "n_removed", "kept_sha256"), lambda d: _remove_repeats(d, length, block_bytes))


def _remove_repeats(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    blocks = B.n_blocks(docs, block_bytes)
    buckets = max(16, blocks)
    base = B.packed(docs, blocks, rest=True)
    by_block = base.groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        values, _, count = (x := _Block(table.select(["doc_id", "row", "body"]), length)).anchors()
        here = table.column("block")[0].as_py()
        return B.mail([(here, b, values[at].tobytes() + np.minimum(count[at], 255).astype(np.uint8).tobytes()) for b, at in B.by_bucket(_bucket(values, buckets))] if len(x.run) else [])

    def answer(table: pa.Table) -> pa.Table:
        got = B.in_order(table, "block")
        values = [np.frombuffer(b, np.uint64, len(b) // 9) for _, b in got]
        counts = np.concatenate([np.frombuffer(b, np.uint8, offset=len(b) // 9 * 8) for _, b in got])
        each, back = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(each))
        status = ((total > 1).astype(np.uint8) + (total > HOT).astype(np.uint8))[back].tobytes()
        ends = np.cumsum([len(v) for v in values])
        bucket = table.column("bucket")[0].as_py()
        return B.mail([(block, bucket, status[e - len(v) : e]) for (block, _), v, e in zip(got, values, ends)])

    first = B.saved(by_block.applyInArrow(ask, B.MAIL).groupBy("bucket").applyInArrow(answer, B.MAIL))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return B.mail([])
        x = _Block(left.select(["doc_id", "row", "body"]), length)
        units = x.distinct(_status(x, B.in_order(right, "bucket"), buckets))
        z, here, out = _Z(), left.column("block")[0].as_py(), {}
        for (group, words), ((w, stop), *_) in units.items():
            d = int(x.doc[w])
            a, o, t = out.setdefault(group % buckets, ([], [], []))
            a.append((group, stop - w))
            o.append((_NULL_ID if x.ids[d] is None else x.ids[d], x.row[d], w - int(x.first[d])))
            t.append(words)
        return B.mail([(here, b, np.uint32(len(t)).tobytes() + np.array([g for g, _ in a], np.uint64).tobytes() + np.array([n for _, n in a], np.uint8).tobytes() + np.array(o, np.int64).tobytes() + z.compress(b"\n".join(t))) for b, (a, o, t) in out.items()])

    def judge(table: pa.Table) -> pa.Table:
        """For each passage sent: which of its windows have an earlier equal one."""
        z, shards, replies = zstandard.ZstdDecompressor(), {}, []
        got = B.in_order(table, "block")
        for i, (_, body) in enumerate(got):
            n = int(np.frombuffer(body, np.uint32, 1)[0])
            groups = np.frombuffer(body, np.uint64, n, 4).tolist()
            order = np.frombuffer(body, np.int64, 3 * n, 4 + 9 * n).reshape(n, 3).tolist()
            replies.append(np.zeros(n, np.uint16))
            for j, (g, o, words) in enumerate(zip(groups, order, z.decompress(body[4 + 33 * n :]).split(b"\n"))):
                shards.setdefault(g, []).append((o, words, i, j))
        for shard in shards.values():
            if len(shard) == 1:
                continue
            shard.sort(key=lambda x: x[0])
            seen, reference, many = set(), SuffixAutomaton(), len({x[1] for x in shard}) > 1
            for _, text, i, j in shard:
                if text in seen:
                    replies[i][j] = 0xFFFF
                    continue
                seen.add(text)
                if many:
                    passage = text.split(b" ")
                    if len(seen) > 1:
                        found = reference.statistics(passage)[length - 1 :]
                        replies[i][j] = sum(1 << b for b, m in enumerate(found) if m >= length)
                    reference.add(passage)
        bucket = table.column("bucket")[0].as_py()
        return B.mail([(block, bucket, r.tobytes()) for (block, _), r in zip(got, replies)])

    second = base.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send, B.MAIL).groupBy("bucket").applyInArrow(judge, B.MAIL)
    replies = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))
    rest = base.schema["rest"]
    result = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "rest": left.column("rest"), **{c: pa.array([], pa.int64()) for c in ("n_words", "n_removed")}, "kept_sha256": pa.array([], pa.string())})
        x = _Block(left.select(["doc_id", "row", "body"]), length)
        turn = np.array(right.column("turn").to_pylist())
        units = x.distinct(_status(x, B.in_order(right.filter(pa.array(turn == 1)), "bucket"), buckets))
        masks = {b: iter(np.frombuffer(m, np.uint16).tolist()) for b, m in B.in_order(right.filter(pa.array(turn == 2)), "bucket")}
        mark = np.zeros(len(x.doc) + 1, np.int64)
        for (group, _), places in units.items():
            mask = next(masks[group % buckets])
            for w, stop in places:
                for i in range(stop - w):
                    if mask >> i & 1:
                        mark[w + i] += 1
                        mark[w + i + length] -= 1
                mask = 0xFFFF
        gone = np.cumsum(mark[:-1]) > 0
        text, removed, digest = [], [], []
        for d, norm in enumerate(x.norm):
            lo, n = int(x.first[d]), int(x.n_words[d])
            g = gone[lo : lo + n]
            removed.append(int(g.sum()))
            if removed[-1]:
                kept = b" ".join([w for w, out in zip(norm.split(b" "), g.tolist()) if not out])
                text.append(kept)
            else:
                kept = norm
                text.append(x.texts[d])
            digest.append(hashlib.sha256(kept).hexdigest())
        return pa.table({
            "doc_id": pa.array(x.ids, pa.int64()), "text": pa.array(text, pa.binary()).cast(pa.string()), "rest": left.column("rest").take(pa.array(x.rows)),
            "n_words": pa.array(x.n_words), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
        })

    done = base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut, result)
    return done.select(*B.restored(done, docs, "doc_id", "text"), "n_words", "n_removed", "kept_sha256")


#: The same result in SQL, for documents with distinct ids.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY doc_id),
p AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM c) x ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
