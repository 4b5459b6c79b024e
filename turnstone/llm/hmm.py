"""Operator 8, LM scoring: a hidden Markov language model.

Tokens are words (A-Z lower-cased) and one end. States emit words. Training is Baum-Welch over
all training documents, in two stages:

1. ``passes`` passes in which states emit one of ``classes`` word classes (by a hash of the
   word's last three bytes). Expected counts are summed over partitions; they have states x
   classes cells, a size set by parameters, and give the moves between states and a first
   idea of what each state emits.
2. a pass that gathers the expected count of every (word, state): a table that grows with the
   vocabulary of the corpus, kept in buckets (hash ranges of words) and never in one place.
   A word's share of a state is its expected count there, drawn towards its class's share
   with the weight of ``DRAW`` occurrences, so that rare words borrow from their class.

A state's probability of a word is that share times the word's smoothed frequency, over the
same summed for all words (known ones, and one unseen in each class), so it adds up to one.

Both recursions are exact over whole documents. Documents are cut in rows of at most
``SEGMENT`` tokens that run side by side; what enters and leaves a row inside of a long
document comes from products of the rows' states x states matrices. Scores are the exact
likelihood of the whole text by the scaled forward recursion.

Texts are read and tokenised once, where they lie, into packs of numbered words; only packs are
exchanged. The corpus's words are never broadcast or collected: each pack sends its distinct
words with their counts and expected counts to buckets, and is sent the corpus counts and
shares of just those words. A word that a third of all documents have is one entry a pack.

Cases: null and empty texts have one token, the end; a null doc_id hashes as empty text;
repeated rows count and are scored each; without training tokens all words are unseen.
Empty tables give empty results; other columns pass through, columns made here are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import words as W

STATES, CLASSES, PASSES, SEGMENT = 6, 2048, 3, 1024
END = b"\n"  # no word holds white space
SMOOTH = 0.1
#: Occurrences as many as which a word's class weighs in its share of each state.
DRAW = 1.0
MADE = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
_TOP = 65535  # shares travel as 16-bit numbers


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def word_class(word: bytes, classes: int) -> int:
    return 0 if word == END else 1 + zlib.crc32(word[-3:]) % (classes - 1)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


class _numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _expanded(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


_JOIN = b"\x20"  # no word holds a space
_NO_ID = np.iinfo(np.int64).min
_KIND = {"tokens": np.uint32, "lengths": np.int64, "training": np.bool_, "ids": np.int64, "kind": np.uint16}


def _packs(docs: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """Packs of documents as they lie in their partitions, block_bytes of text each, spread over blocks and saved.

    block, rest (of each document), body (training tokens of each class), words (distinct ones, in order of
    appearance) and the arrays of _KIND: token numbers, tokens a text, whether it trains, doc_ids, and the class of
    each word.
    """
    B.ready(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"), B.rest_of(docs, "doc_id", "text").alias("rest"))
    rest = frame.schema["rest"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("words", T.BinaryType()), *[T.StructField(c, T.BinaryType()) for c in _KIND], T.StructField("rest", T.ArrayType(rest))])

    def packed(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        place = _numbers()
        ids = table.column("doc_id").to_pylist()
        seqs = [np.array([*map(place.__getitem__, tokens(t))], np.uint32) for t in table.column("body").to_pylist()]
        arrays = {
            "tokens": np.concatenate(seqs), "lengths": np.array([len(s) for s in seqs], np.int64), "training": np.array([not held_out(i) for i in ids]),
            "ids": np.array([_NO_ID if i is None else i for i in ids], np.int64), "kind": np.array([word_class(w, CLASSES) for w in place], np.uint16),
        }
        trained = [s for s, t in zip(seqs, arrays["training"]) if t]
        classes = np.bincount(arrays["kind"][np.concatenate(trained)], minlength=CLASSES) if trained else np.zeros(CLASSES)
        kept = table.column("rest").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([classes.astype(np.float64).tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(_JOIN.join(place))], pa.binary()), *[pa.array([_squeezed(arrays[c])], pa.binary()) for c in _KIND], lists,
        ], names=[f.name for f in schema])

    def run(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("body")), 0).to_pylist()
            lo = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= block_bytes:
                    yield packed(number, [*held, batch.slice(lo, i + 1 - lo)])
                    held, size, number, lo = [], 0, number + 1, i + 1
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield packed(number, held)

    return B.saved(frame.mapInArrow(run, schema).repartition(blocks, "block"), laid_out=True)


class _Pack:
    def __init__(self, row: dict) -> None:
        self.number, self._words = row["block"], row["words"]
        for c, kind in _KIND.items():
            setattr(self, c, np.frombuffer(_expanded(row[c]), kind))
        self.seqs = np.split(self.tokens, np.cumsum(self.lengths)[:-1])

    def trained(self) -> list[np.ndarray]:
        return [s for s, t in zip(self.seqs, self.training) if t]

    @cached_property
    def words(self) -> list[bytes]:
        return _expanded(self._words).split(_JOIN)

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with the numbers of its words."""
        return B.by_bucket(np.fromiter((zlib.crc32(w) % n for w in self.words), np.int64, len(self.words)))


def _each(batches) -> Iterator[_Pack]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Pack(b.slice(i, 1).select(["block", "words", *_KIND]).to_pylist()[0])


def _summed(bodies: DataFrame, n: int) -> np.ndarray:
    """The sum of packed arrays of n numbers (n set by parameters), added up by Spark; cells that are zero stay out."""

    def unpack(batches):
        total = np.zeros(n)
        for b in batches:
            for body in b.column("body").to_pylist():
                total += np.frombuffer(body, np.float64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "x"])

    out = np.zeros(n)
    for cell, x in bodies.select("body").mapInArrow(unpack, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[cell] = x
    return out


# ---- the model ---------------------------------------------------------------------------


class _Rows:
    """Sequences cut in rows of at most SEGMENT tokens, laid out step by step: first tokens of all rows, second ones, ..."""

    def __init__(self, seqs: list[np.ndarray], segment: int = 0) -> None:
        segment = segment or SEGMENT
        lengths = np.array([len(s) for s in seqs], np.int64)
        parts = -(-lengths // segment)
        doc = np.repeat(np.arange(len(seqs)), parts)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(segment, lengths[doc] - part * segment)
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        self.doc, self.part, self.last, size = doc[order], part[order], (part == parts[doc] - 1)[order], size[order]
        self.steps = int(size[0]) if len(size) else 0
        self.alive = len(size) - np.searchsorted(size[::-1], np.arange(self.steps), "right")
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        to = self.at[step] + row
        flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        self.token, self.row = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        self.token[to], self.row[to] = flat[np.repeat(begin, size) + step], row
        self.size, self.documents = size, len(seqs)


class Model:
    """start (K), move (K x K) and emit (K x classes): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, class_tokens: np.ndarray) -> "Model":
        """Class frequencies, disturbed by hashed noise so that states can part; states tend to stay."""
        share = (class_tokens + SMOOTH) / (class_tokens + SMOOTH).sum()
        noise = W.mix(np.arange(states * len(share), dtype=np.uint64)).astype(np.float64).reshape(states, -1) / 2**64
        emit = share * (0.4 + 1.2 * noise)
        stay = 0.95
        move = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def shares(self) -> np.ndarray:
        """classes x K: how a class's tokens are shared among the states."""
        occupied = self.start.copy()
        for _ in range(200):
            occupied = occupied @ self.move
        x = (self.emit * occupied[:, None]).T
        return x / x.sum(axis=1, keepdims=True)

    def _ends(self, r: _Rows, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the states before its first token's move, and the relative likelihood of all after it."""
        k, n = len(self.start), len(r.doc)
        before, after = np.tile(self.start, (n, 1)), np.ones((n, k))
        long = np.flatnonzero(np.bincount(r.doc, minlength=r.documents)[r.doc] > 1)
        if not len(long):
            return before, after
        product = np.tile(np.eye(k), (len(long), 1, 1))
        inner = r.part[long] > 0
        for t in range(r.steps):
            m = int(np.searchsorted(long, r.alive[t]))  # rows are in order of size, so those of long texts are too
            if not m:
                break
            b = emit[r.token[r.at[t] + long[:m]]][:, None, :]
            moved = (product[:m].reshape(-1, k) @ self.move).reshape(m, k, k)
            step = (np.where(inner[:m, None, None], moved, product[:m]) if t == 0 else moved) * b
            product[:m] = step / step.sum(axis=(1, 2))[:, None, None]
        place = {(int(r.doc[i]), int(r.part[i])): (i, j) for j, i in enumerate(long.tolist())}
        for (d, p), (i, j) in sorted(place.items()):
            if (d, p + 1) in place:
                x = before[i] @ product[j]
                before[place[d, p + 1][0]] = x / x.sum()
        for (d, p), (i, j) in sorted(place.items(), reverse=True):
            if p:
                x = product[j] @ after[i]
                after[place[d, p - 1][0]] = x / x.sum()
        return before, after

    def _forward(self, r: _Rows, emit: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales, in the rows' layout."""
        alpha, scale = emit[r.token], np.empty(len(r.token), emit.dtype)
        a = np.where((r.part > 0)[:, None], before @ self.move, before).astype(emit.dtype)
        one, move = np.ones(len(self.start), emit.dtype), self.move.astype(emit.dtype)
        for t in range(r.steps):
            here = slice(r.at[t], r.at[t + 1])
            if t:
                a = a[: r.alive[t]] @ move
            a = np.multiply(a, alpha[here], out=alpha[here])
            s = a @ one
            a /= s[:, None]
            scale[here] = s
        return alpha, scale

    def counts(self, seqs: list[np.ndarray], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts and moves, tokens with their expected states (one row each), and log10 likelihood.

        emit: a row of K probabilities for each token number.
        """
        r = _Rows(seqs)
        before, after = self._ends(r, emit)
        alpha, scale = self._forward(r, emit, before)
        beta, moves = after, np.zeros((len(self.start),) * 2)
        beta /= (beta * alpha[r.at[r.size - 1] + np.arange(len(r.size))]).sum(axis=1)[:, None]  # now sums with the last forward row to one
        beta, back = beta.astype(emit.dtype), np.ascontiguousarray(self.move.T.astype(emit.dtype))
        for t in range(r.steps - 1, -1, -1):
            m, here = r.alive[t], slice(r.at[t], r.at[t + 1])
            b = beta[:m]
            ahead = emit[r.token[here]] * b
            ahead /= scale[here][:, None]
            alpha[here] *= b
            if t:
                moves += alpha[r.at[t - 1] : r.at[t - 1] + m].T @ ahead
                beta[:m] = ahead @ back
            else:
                inner = r.part > 0
                moves += before[inner].T @ ahead[inner]
                first = alpha[here][~inner]
        return first.sum(axis=0), moves * self.move, r.token, alpha, float(np.log10(scale).sum(dtype=np.float64))

    def score(self, seqs: list[np.ndarray], emit: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence; emit: a row of K probabilities for each token number."""
        r = _Rows(seqs)
        _, scale = self._forward(r, emit, self._ends(r, emit)[0])
        return np.bincount(r.doc[r.row], np.log10(scale), minlength=len(seqs))


def _sums(packs: DataFrame, n: int, of) -> np.ndarray:
    """The sum over all packs of of(pack), n numbers."""

    def run(batches):
        total = np.zeros(n)
        for x in _each(batches):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["body"])

    return _summed(packs.drop("rest").mapInArrow(run, "body binary"), n)


def _class_pass(packs: DataFrame, model: Model) -> tuple[Model, float]:
    """One Baum-Welch pass over all training documents, words standing for their classes."""
    k, c = model.emit.shape
    n = k + k * k + k * c + 1

    def of(x: _Pack) -> np.ndarray:
        seqs = x.trained()
        if not seqs:
            return np.zeros(n)
        start, moves, token, state, log = model.counts(seqs, model.emit.T[x.kind].astype(np.float32))
        kinds = x.kind[token]
        return np.concatenate([start, moves.ravel(), *[np.bincount(kinds, state[:, s], minlength=c) for s in range(k)], [log]])

    total = _sums(packs, n, of)
    smooth = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
    return Model(smooth(total[:k], 0.1), smooth(total[k : k + k * k].reshape(k, k), 0.1), smooth(total[k + k * k : -1].reshape(k, c), 0.01)), float(total[-1])


def _word_pass(packs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """For each pack and bucket the corpus counts and the states' shares of the words sent; and of each bucket (as pack -1) its training tokens, its words with any, and its part of each state's sum."""
    k, share = len(model.start), model.shares()

    def send(batches):
        for x in _each(batches):
            n, seqs = len(x.words), x.trained()
            expected, own = np.zeros((n, k)), np.zeros(n, np.int64)
            if seqs:
                _, _, token, state, _ = model.counts(seqs, model.emit.T[x.kind].astype(np.float32))
                own = np.bincount(token, minlength=n)
                for s in range(k):
                    expected[:, s] = np.bincount(token, state[:, s], minlength=n)
            part = np.rint(expected / np.maximum(own, 1)[:, None] * _TOP).clip(0, _TOP).astype(np.uint16)
            rows = []
            for b, at in x.buckets(buckets):
                some = own[at] > 0  # of words that only held-out texts have there is nothing to tell
                rows.append((x.number, b, np.uint32(len(at)).tobytes() + _squeezed(own[at].astype(np.uint32), part[at[some]], np.frombuffer(_JOIN.join([x.words[i] for i in at]), np.uint8))))
            yield from B.mail(rows, pa.int64()).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        place, sent = _numbers(), []
        for pack, body in B.in_order(table, "block"):
            n, raw = int(np.frombuffer(body, np.uint32, 1)[0]), _expanded(body[4:])
            own = np.frombuffer(raw, np.uint32, n)
            some = np.flatnonzero(own)
            part = np.frombuffer(raw, np.uint16, k * len(some), 4 * n).reshape(-1, k)
            at = np.array([*map(place.__getitem__, raw[4 * n + 2 * k * len(some) :].split(_JOIN))], np.int64)
            sent.append((pack, at, own, some, part))
        count, of = np.zeros(len(place)), np.zeros((len(place), k))
        for _, at, own, some, part in sent:  # a pack's words differ, so plain indexing adds each once
            count[at] += own
            of[at[some]] += own[some, None] * (part / _TOP)
        kind = np.array([word_class(w, CLASSES) for w in place], np.int64)
        code = 1 + np.rint((of + DRAW * share[kind]) / (of.sum(axis=1) + DRAW)[:, None] * (_TOP - 1)).astype(np.int64)
        known = count > 0
        sums = (code[known] / _TOP * (count[known] + SMOOTH)[:, None]).sum(axis=0)
        bucket = table.column("bucket")[0].as_py()
        replies = [(pack, bucket, _squeezed(count[at].astype(np.int64), code[at[known[at]]].astype(np.uint16))) for pack, at, *_ in sent]
        return B.mail([*replies, (-1, bucket, np.array([count.sum(), known.sum(), *sums]).tobytes())], pa.int64())

    mail = T.StructType([T.StructField("block", T.LongType()), *B.MAIL.fields[1:]])
    return B.saved(packs.drop("rest").mapInArrow(send, mail).groupBy("bucket").applyInArrow(answer, mail))


def scored(docs: DataFrame, *, states: int = STATES, passes: int = PASSES, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """docs without text, with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    return B.shielded(docs, ("doc_id", "text"), MADE, lambda d: _scored(d, states, passes, block_bytes))


def _scored(docs: DataFrame, states: int, passes: int, block_bytes: int) -> DataFrame:
    blocks = B.n_blocks(docs, block_bytes)
    buckets = max(16, blocks // 2)
    packs = _packs(docs, blocks, block_bytes)
    model = Model.first(states, _summed(packs, CLASSES))
    for _ in range(passes):
        model, _ = _class_pass(packs, model)
    replies = _word_pass(packs, model, buckets)
    n, v, *sums = _summed(replies.where("block = -1"), 2 + states).tolist()
    shares = model.shares()
    total = np.array(sums) + SMOOTH * shares.sum(axis=0)  # with one unseen word in each class
    rest = packs.schema["rest"].dataType.elementType
    result = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("rest", rest), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, answers = [], dict(B.in_order(right, "bucket"))
        for x in _each(left.to_batches()):
            share, count = shares[x.kind], np.zeros(len(x.words), np.int64)
            for b, at in x.buckets(buckets):
                raw = _expanded(answers[b])
                count[at] = np.frombuffer(raw, np.int64, len(at))
                known = at[count[at] > 0]
                share[known] = np.frombuffer(raw, np.uint16, states * len(known), 8 * len(at)).reshape(-1, states) / _TOP
            unigram = np.log10((count + SMOOTH) / (n + SMOOTH * (v + 1)))
            add = lambda y: np.add.reduceat(y[x.tokens], np.cumsum(x.lengths) - x.lengths)
            score = model.score(x.seqs, share * (count + SMOOTH)[:, None] / total)
            parts.append([pa.array(x.ids, mask=x.ids == _NO_ID), pa.array(~x.training), pa.array(x.lengths), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(x.ids), int(n), np.int64)), pa.array(add(unigram)), pa.array(score)])
        kept = left.column("rest").combine_chunks().flatten() if left.num_rows else pa.array([], left.schema.field("rest").type.value_type)
        columns = [pa.concat_arrays(p) for p in zip(*parts)] if parts else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return pa.Table.from_arrays([columns[0], kept, *columns[1:]], names=[f.name for f in result])

    out = packs.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(final, result)
    return out.select(*B.restored(out, docs.drop("text"), "doc_id"), *MADE)
