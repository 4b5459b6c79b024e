"""Operator 9, BPE encoding and decoding: content-defined chunk reuse.

A rolling hash over the last 16 bytes picks cut points at white space, about every 128 words,
so equal passages are cut into equal chunks wherever they stand. A worker encodes a chunk
once and keeps its ids and decoded text; inside a new chunk, words it has met before are
reused the same way, so the tokenizers library sees each different word about once. Where
two chunks join, the words on both sides are re-encoded together and compared with the
joined results; while they differ the stretch grows by a word on each side, and a join that
needed that is repaired by encoding the two chunks as one, until all joins agree.

Reuse tables live in the worker, are bounded (two generations of ``KEEP_WORDS`` words and
``KEEP_CHUNKS`` chunks) and hold only what can be made again, so a lost executor loses
nothing. There is no shuffle and nothing is broadcast.

Cases: null text is encoded as the empty text; empty texts have no ids; texts without white
space are one chunk; a special token's string in a text becomes its id, as in the library.
Repeated rows give repeated results. Empty tables give empty results; columns of the names
made here are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import words as W

KEEP_WORDS, KEEP_CHUNKS = 150_000, 4_000
#: A cut is made at white space where the rolling hash has this many zero bits.
CUT_BITS, ROLL = 7, 16
_tables: dict = {}


class _Reuse:
    """A bounded mapping: when the young generation is full it becomes the old one."""

    def __init__(self, keep: int) -> None:
        self.keep, self.young, self.old = keep, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Encodes UTF-8 texts as a tokenizers file does, through chunks and words seen before."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        # without a decoder, decoding joins the tokens by spaces
        self.tokens = [self.library.id_to_token(i) for i in range(size)] if self.library.decoder is None else None
        self.words, self.chunks, self.joins = _Reuse(KEEP_WORDS), _Reuse(KEEP_CHUNKS), _Reuse(KEEP_WORDS)

        # reuse by words needs a vocabulary that lower-cases, drops white space and parts words from punctuation
        probe = b"Aa bB, cc.\nThe end"
        parts = [self.whole(w) for w in (b"aa", b"bb", b",", b"cc", b".", b"the", b"end")]
        self.by_words = self.whole(probe) == (b"".join(p[0] for p in parts), " ".join(p[1] for p in parts))

    def _pair(self, ids: list[int]) -> tuple[bytes, str]:
        text = " ".join([self.tokens[i] for i in ids]) if self.tokens else self.library.decode(ids, skip_special_tokens=False)
        return array("I", ids).tobytes(), text

    def whole(self, text: bytes) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits) and decoded text, by the library alone."""
        return self._pair(self.library.encode(text.decode(), add_special_tokens=False).ids)

    def learn(self, words: set[bytes]) -> None:
        """Encode new words, many in one call; offsets tell which word a token is of."""
        new = [w for w in words if self.words.get(w) is None]
        for lo in range(0, len(new), 128):
            part = new[lo : lo + 128]
            text = [w.decode() for w in part]
            e = self.library.encode(" ".join(text), add_special_tokens=False)
            ids, starts = e.ids, list(accumulate((len(t) + 1 for t in text), initial=0))
            of = [bisect_right(starts, a) - 1 for a, _ in e.offsets]
            i = 0
            for n, w in enumerate(part):
                j = i
                while j < len(of) and of[j] == n:
                    j += 1
                self.words.put(w, self._pair(ids[i:j]))
                i = j

    def chunk(self, chunk: bytes) -> tuple[bytes, str]:
        words = split(chunk)
        get = self.words.young.get
        found = [get(w) or self._word(w) for w in words]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    def _word(self, word: bytes) -> tuple[bytes, str]:
        found = self.words.get(word)
        if found is None:
            found = self.whole(word)
            if len(word) < 200:
                self.words.put(word, found)
        return found

    def _agree(self, left: list[bytes], right: list[bytes]) -> int:
        """How many words on each side of a join must be encoded together; 0 if joining is exact."""
        n = 1
        while True:
            a, b = left[-n:], right[:n]
            key = (b" ".join(a), b" ".join(b))
            if len(key[0]) + len(key[1]) > 400:
                same = self._joins_exactly(key)
            elif (same := self.joins.get(key)) is None:
                self.joins.put(key, same := self._joins_exactly(key))
            if same:
                return n - 1
            if n >= max(len(left), len(right)):
                return n
            n += 1

    def _joins_exactly(self, key: tuple[bytes, bytes]) -> bool:
        a, b = self.chunk(key[0]), self.chunk(key[1])
        return self.whole(b" ".join(key)) == (a[0] + b[0], " ".join(x for x in (a[1], b[1]) if x))

    def texts(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        if not self.by_words:
            return [self.whole(t) for t in texts]
        pieces = [cut(t) for t in texts]
        fresh = {c for p in pieces for c in p if self.chunks.get(c) is None}
        unseen: set[bytes] = set()
        for c in fresh:
            unseen.update(split(c))
            if len(unseen) >= KEEP_WORDS // 2:
                break
        self.learn({w for w in unseen if len(w) < 200})
        return [self._text(p) for p in pieces]

    def _text(self, pieces: list[bytes]) -> tuple[bytes, str]:
        done, tail = [], None
        for piece in pieces:
            words = piece.split()
            if not words:
                continue
            if tail is not None and (n := self._agree(tail, words)):
                # Joining is not exact here: encode both chunks as one.
                piece = done.pop()[2] + piece
                done.append((*self.whole(piece), piece))
                tail = piece.split()
                continue
            found = self.chunks.get(piece)
            if found is None:
                found = self.chunk(piece)
                if len(piece) < 4096:
                    self.chunks.put(piece, found)
            done.append((*found, piece))
            tail = words
        return b"".join([d[0] for d in done]), " ".join([d[1] for d in done if d[1]])


_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\n]|$)")


def split(chunk: bytes) -> list[bytes]:
    """The words of a chunk, so that fewer differ: in lower case, and parted from a full stop or comma at their end.

    Vocabularies that reuse by words lower-case what they are given and part letters from
    punctuation (others are encoded whole), so the ids stay the same; a chunk that may hold a
    special token is left as it is.
    """
    return chunk.split() if b"<|" in chunk else _STOP.sub(rb" \1", chunk.lower()).split()


def cut(text: bytes) -> list[bytes]:
    """Content-defined chunks of a text; each starts with the white space it was cut at."""
    buf = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(W.SPACE[buf])
    at = at[at >= ROLL]
    roll = np.zeros(len(at), np.uint64)
    for j in range(1, ROLL + 1):
        roll = roll * W.P1 + buf[at - j]
    ends = at[(W.mix(roll) & np.uint64((1 << CUT_BITS) - 1)) == 0].tolist()
    return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)]) if i < j]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _tables:
        _tables[path] = Encoder(path)
    return _tables[path]


MADE = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, vocabulary: str, *, ids: bool = True, decoded: bool = True) -> DataFrame:
    """docs with n_tokens, ids (array<int>), decoded (string), ids_sha256 and decoded_sha256."""
    return B.shielded(docs, ("text",), MADE, lambda d: _encoded(d, vocabulary, ids, decoded))


def _encoded(docs: DataFrame, vocabulary: str, ids: bool, decoded: bool) -> DataFrame:
    B.ready(docs.sparkSession)
    frame = docs.select(*docs.columns, F.col("text").cast("string").cast("binary").alias("_body"))
    made = [T.StructField("n_tokens", T.LongType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids, *[T.StructField("decoded", T.StringType())] * decoded, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches):
        tool = encoder(vocabulary)
        for b in batches:
            got = tool.texts([x or b"" for x in b.column("_body").to_pylist()])
            b = b.drop_columns(["_body"])
            new = {"n_tokens": pa.array([len(i) // 4 for i, _ in got], pa.int64())}
            if ids:
                flat = np.frombuffer(b"".join([i for i, _ in got]), "<i4")
                new["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(i) // 4 for i, _ in got]]), pa.int32()), pa.array(flat))
            if decoded:
                new["decoded"] = pa.array([t for _, t in got], pa.string())
            new["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i, _ in got])
            new["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got])
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], names=[*b.schema.names, *new])

    return frame.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))
