"""Byte-level BPE encoding and decoding without running the merges.

Pieces (matches of the split pattern) are encoded one by one. Bytes become Latin-1 characters, an Aho-Corasick automaton
gives the longest token at each place, and the encoder walks left to right, backing up to shorter tokens where two
neighbours could not stand side by side after the merges. Whether they could is decided from how each token came to be
(its last merge) and remembered. A place from which no way leads on is marked and never tried again, so the walk is
linear in the piece, however long. A piece that is itself a token is that token, as in tiktoken.

Defined results: null text is empty and has no tokens; repeated rows stay; an empty table gives no rows; a text of any
length is handled piece by piece; further columns are passed on by encode() and decode(), which refuse an input that
already has a column of the name they add.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._batch import HELD
from millrace.llm._spark import small_batches

PIECES_KEPT, PIECE_CHARS, PAIRS_KEPT = 150_000, 48, 500_000  #: bounds of the memories of one worker


def read_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        got = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(r) for _, r in got) + 1)
    for coded, rank in got:
        tokens[int(rank)] = base64.b64decode(coded)
    return tuple(tokens)


@functools.lru_cache(maxsize=4)
def splits(tokens: tuple[bytes, ...]) -> np.ndarray:
    """For each token the two it was last merged from; itself twice for single bytes; -1 where the merges never make it."""
    rank = {t: i for i, t in enumerate(tokens) if t}
    out = np.full((len(tokens), 2), -1, np.int64)
    for own, token in enumerate(tokens):
        if len(token) == 1:
            out[own] = own
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = own, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], own)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in rank for p in parts):
            out[own] = [rank[p] for p in parts]
    return out


class Codec:
    def __init__(self, tokens: tuple[bytes, ...], pattern: str, split: np.ndarray | None = None):
        split = splits(tokens) if split is None else split
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.left, self.right = split[:, 0].tolist(), split[:, 1].tolist()
        self.made = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0 and len(tokens[i]) > 1}
        self.size = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if t and self.left[i] >= 0:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(tokens)  #: the longest token that a token begins with
        for i, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                if (j := self.rank.get(t[:n], -1)) >= 0 and self.left[j] >= 0:
                    self.shorter[i] = j
                    break
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _stand_together(self, a: int, b: int) -> bool:
        """Would the merges leave a next to b? Undo the later of their last merges, and see whether an earlier merge would have crossed."""
        limit = len(self.tokens) + 1
        while True:
            if self.made.get((a, b), limit) < limit:
                return False
            undo_a = a > b
            for _ in range(2):
                if undo_a:
                    if self.size[a] > 1:
                        limit, a = a, self.right[a]
                        break
                elif self.size[b] > 1:
                    limit, b = b + 1, self.left[b]
                    break
                undo_a = not undo_a
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            got = self.pairs[a, b] = self._stand_together(a, b)
        return got

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        n, size, shorter = len(data), self.size, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end - size[token] + 1] = token  # ends come in order, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a single byte")
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= PIECE_CHARS:
                    if len(known) >= PIECES_KEPT:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(shared) -> Codec:
    if shared.id not in HELD:
        HELD.clear()
        HELD[shared.id] = Codec(*shared.value)
    return HELD[shared.id]


class _Held:
    """A broadcast with its number: the vocabulary has a fixed size, whatever the corpus."""

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        self.broadcast = spark.sparkContext.broadcast((tokens, pattern, splits(tokens)))
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _mapped(df: DataFrame, added: dict[str, T.DataType], make) -> DataFrame:
    for name in added:
        if name in df.columns:
            raise ValueError(f"the input already has a column {name}")
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``: binary, little-endian unsigned 32-bit token ids."""
    held = _Held(df.sparkSession, path, pattern)

    def make(part):
        codec = _codec(held)
        return [pa.array([codec.encode(x or "") for x in part.column(text).to_pylist()], pa.binary())]

    return _mapped(df, {"ids": T.BinaryType()}, make)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the bytes of the tokens in ``ids``."""
    held = _Held(df.sparkSession, path, pattern)

    def make(part):
        codec = _codec(held)
        return [pa.array([codec.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())]

    return _mapped(df, {"decoded": T.BinaryType()}, make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass of the Python workers."""
    held = _Held(df.sparkSession, path, pattern)

    def make(part):
        codec = _codec(held)
        ids = [codec.encode(x or "") for x in part.column(text).to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())]

    return _mapped(df, {"ids": T.BinaryType(), "decoded": T.BinaryType()}, make)
