"""Language identification: multinomial naive Bayes over hashed character n-grams.

The classes are the distinct non-null values of ``lang`` among the rows that may be learned from; counts come from all of
those rows. Workers add up n-gram counts in a dense row a language, Spark sums them, and one log-probability matrix
(languages x buckets, at most 2 ** CELLS floats) is broadcast. Scoring keeps a batch as (text, bucket) pairs and adds the
matrix entries up by text. Long texts are read in pieces of PIECE code points whose sums are added.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = 3  #: n-grams of 1 to so many code points
BITS = 16  #: a matrix row has 2 ** BITS buckets, fewer where there are more than 2 ** (CELLS - BITS) languages
CELLS = 22
LANGUAGES = 4096  #: more than so many values of ``lang`` are refused
ALPHA = 0.1  #: added to every bucket's count
PIECE = 1 << 19
UNKNOWN = "und"
_GAP = 32
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the small letter, or a gap for what is no letter."""
    table = np.full(0x110000, _GAP, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            small = c.lower()
            table[ord(c)] = ord(small) if len(small) == 1 else ord(c)
    return table


def _points(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _grams(points: np.ndarray, new: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(end place, bucket) for each order: the n-grams that end at place ``new`` or later and hold no two gaps in a row."""
    wide = points.astype(np.uint64)
    gap = points == _GAP
    bad = gap  # of order 1: a lone gap; of higher orders: two gaps side by side
    pair = np.zeros(len(points), bool)
    pair[1:] = gap[1:] & gap[:-1]
    with np.errstate(over="ignore"):
        total = np.zeros(len(points), np.uint64)
        for k in range(ORDERS):
            total[k:] = total[k:] + wide[: len(points) - k] * _MULTIPLY[k]
            if k:
                bad = pair.copy() if k == 1 else bad | np.concatenate([np.zeros(k - 1, bool), pair[: len(pair) - k + 1]])
            at = np.flatnonzero(~bad)
            at = at[at >= max(new, k)]
            ids = ((total[at] ^ np.uint64(k)) * _MULTIPLY[0]) >> np.uint64(64 - bits)
            yield at, ids.astype(np.int64)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(code points, starts of rows, first row, places that came before): short texts together, a long one in pieces."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= PIECE):
            size += len(texts[hi] or "") + 2
            hi += 1
        own = [t or "" for t in texts[lo:hi]]
        if hi == lo + 1 and len(own[0]) > PIECE:
            whole = own[0]
            for a in range(0, len(whole), PIECE):
                before = whole[max(0, a - ORDERS + 1) : a] if a else "\n"
                end = "\n" if a + PIECE >= len(whole) else ""
                yield _points(before + whole[a : a + PIECE] + end), np.zeros(1, np.int64), lo, len(before) if a else 0
        else:
            starts = np.cumsum([0, *[len(t) + 2 for t in own[:-1]]])
            yield _points("".join(f"\n{t}\n" for t in own)), starts, lo, 0
        lo = hi


@dataclasses.dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  #: float32, langs x buckets: log probabilities
    prior: np.ndarray

    def __post_init__(self):
        self.bits = int(self.matrix.shape[1]).bit_length() - 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior; ``und`` and 0 where a text has no letter or nothing was learned."""
        letters, sums = np.zeros(len(texts), np.int64), np.zeros((len(self.langs), len(texts)))
        for points, starts, first, new in _pieces(texts) if self.langs else ():
            for k, (at, ids) in enumerate(_grams(points, new, self.bits)):
                row = np.searchsorted(starts, at, "right") - 1
                if k == 0:
                    letters[first : first + len(starts)] += np.bincount(row, minlength=len(starts))
                for own, into in zip(self.matrix, sums, strict=True):
                    into[first : first + len(starts)] += np.bincount(row, own[ids], len(starts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        # a code point is counted once an order, so a text's evidence is the mean of the orders
        odds = self.prior[:, None] + sums / ORDERS
        best = odds.argmax(0)
        score = 1 / np.exp(odds - odds.max(0)).sum(0)
        known = letters > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.round(score, 6), 0.0)


def held_out(doc_id: Column) -> Column:
    """The rows that may not be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n), partial; bucket -1 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, row in have.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])
            have.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            mine: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                mine.setdefault(lang, []).append(text)
            for lang, own in mine.items():
                if lang not in have and len(have) >= max(4, 1 << (CELLS - bits)):
                    yield from out()
                row = have.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                row[0] += len(own)
                for points, _, _, new in _pieces(own):
                    for _, ids in _grams(points, new, bits):
                        row[1:] += np.bincount(ids, minlength=1 << bits)
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")


def train(docs: DataFrame) -> Model:
    """Learn from every row with a text, a language and an id that isn't held out. Without such rows the model knows nothing.

    Rows that repeat are counted as often as they stand there; rows without an id are not learned from.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = rows.select("lang").distinct().count()
    if known > LANGUAGES:
        raise ValueError(f"{known} values of lang: more than {LANGUAGES} are no languages")
    bits = min(BITS, CELLS - (max(known, 1) - 1).bit_length())
    got = _counts(rows, bits).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** CELLS short rows
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), (1 << bits) + 1))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy() + 1] = got.column("n").to_numpy()
    grams = counts[:, 1:] + ALPHA
    matrix = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    return Model(langs, matrix, np.log(counts[:, 0] / max(counts[:, 0].sum(), 1)))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to all rows of ``df``, which must not have such columns."""
    if taken := {"lang_pred", "score"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(taken)}")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = sent.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; ``lang`` serves for learning only."""
    out = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
