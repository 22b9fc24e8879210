"""Quality rules: counts over whole texts, and a calibrated logistic regression over hashed n-grams.

Features are the shares of hashed words and word pairs (one half of the table) and of hashed trigrams of
code points (the other half). The regression is fitted on the driver from at most LABELLED labelled rows, calibrated by
Platt's method on a fold it did not learn from, and scored in Arrow batches: a text's logit is the mean weight of its
n-grams, so nothing of the table's width is built per text. A text is kept when no base rule fails and its calibrated
chance of label 1 is at least KEEP.

Defined results: null text counts as empty, has no words and fails the base rules; without any label, or with labels
of one kind only, the chance is the labels' mean (0.5 without any); repeated rows stay; an empty table gives no rows;
judge() passes further columns on and refuses an input that already has a column of a name it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import _batch, _stats
from millrace.llm._batch import Words

LABELLED = 4_000  #: bound of the labelled rows learned from
HALF = 2048  #: hashed columns for words and as many for characters
STEPS, L2, RATE = 120, 1.0, 0.01
KEEP = 0.5
LEAST_WORDS, MOST_REPEATED = 20, 30  #: words; repeated words in percent


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float


def _columns(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed columns of words and pairs with their row bounds, and of character trigrams with theirs."""
    pairs, where = w.windows(2, h)
    grams = np.concatenate([h, pairs]) >> np.uint64(53)
    rows = len(w.count)
    owner = np.concatenate([np.repeat(np.arange(rows), w.count), np.searchsorted(w.first, where, "right") - 1])
    d = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])[w.at]  # in code points
    if len(d) >= 3:
        with np.errstate(over="ignore"):
            tri = (d[:-2] * np.uint32(2654435761)) ^ (d[1:-1] * np.uint32(2246822519) + np.uint32(374761393)) ^ (d[2:] * np.uint32(3266489917) + np.uint32(668265263))
            tri = ((tri ^ (tri >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(21)
    else:
        tri = np.zeros(0, np.uint32)
    inside = np.ones(len(tri), bool)
    for back in (1, 2):
        edges = starts[1:-1] - back
        inside[edges[(edges >= 0) & (edges < len(tri))]] = False
    at = np.flatnonzero(inside)
    return grams.astype(np.int64), owner, tri[at].astype(np.int64), np.searchsorted(starts, at, "right") - 1


def _row_shares(cols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, share of the row's grams) of every column that a row has, by row and column."""
    key, many = np.unique(owner * HALF + cols, return_counts=True)
    row = key // HALF
    return row, key % HALF, (many / np.maximum(np.bincount(owner), 1)[row]).astype(np.float32)


def logits(w: Words, h: np.ndarray, model: Model) -> np.ndarray:
    grams, owner, tri, tri_owner = _columns(w, h)
    rows = len(w.count)
    mean = lambda table, cols, who: np.bincount(who, table[cols], rows) / np.maximum(np.bincount(who, minlength=rows), 1)
    return mean(model.word, grams, owner) + mean(model.char, tri, tri_owner) + model.bias


def _shares(df: DataFrame) -> DataFrame:
    """(y, fold, at, share): the columns and shares of labelled rows, as packed int32 and float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _batch.buffers(batch.column("text"))
            for lo, hi in _batch.slices(ends):
                w = Words(data, ends, lo, hi)
                parts = _columns(w, w.hashes())
                one, two = _row_shares(*parts[:2]), _row_shares(*parts[2:])
                row, col, part = (np.concatenate([x, y]) for x, y in zip(one, (two[0], two[1] + HALF, two[2]), strict=True))
                by = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[by], np.arange(hi - lo + 1))
                col, part = col[by].astype(np.int32), part[by]
                at = [col[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                share = [part[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), batch.column("fold").slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["y", "fold", "at", "share"])

    return df.select("y", "fold", "text").mapInArrow(run, "y int, fold int, at binary, share binary")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """Full-batch Adam on standardised shares; Platt's slope and shift on fold 3."""
    flat = Model(np.zeros(HALF), np.zeros(HALF), 0.0, 1.0, 0.0)
    if not len(y):
        return flat
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    flat.bias = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return flat
    own = fold != 3 if 0 < (fold == 3).sum() < len(y) and len(set(y[fold != 3])) == 2 and len(set(y[fold == 3])) == 2 else np.ones(len(y), bool)
    centre, scale = x[own].mean(0), 1 / np.maximum(x[own].std(0), 1e-3)
    xs = ((x - centre) * scale).astype(np.float32)
    xo, yo = xs[own], y[own].astype(np.float32)
    v, b = np.zeros(x.shape[1], np.float32), flat.bias
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, STEPS + 1):
        p = sigmoid(xo @ v + b)
        e = (p - yo) / len(yo)
        g = e @ xo + L2 * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        b -= RATE * float(e.sum()) * 4
    z, t = (xs @ v + b)[~own], y[~own]
    slope, shift = 1.0, 0.0
    if len(t):
        good, bad = t.sum(), len(t) - t.sum()
        aim = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))  # Platt's smoothed targets
        for _ in range(50):
            p = sigmoid(slope * z + shift)
            e, h = p - aim, np.maximum(p * (1 - p), 1e-9)
            hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            move = np.linalg.solve(hess, [(e * z).sum() + 1e-3 * (slope - 1), e.sum()])
            slope, shift = slope - move[0], shift - move[1]
            if abs(move).max() < 1e-8:
                break
    v = v * scale
    b -= float(v @ centre)
    return Model(v[:HALF].astype(np.float64), v[HALF:].astype(np.float64), b, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    rows = _shares(_stats.labelled(docs, labels, "quality", bound)).collect()  # at most `bound` rows of at most 32 KB
    rows.sort(key=lambda r: (r["fold"], bytes(r["at"]), bytes(r["share"]), r["y"]))
    x = np.zeros((len(rows), 2 * HALF), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
    return fit(x, np.array([r["y"] for r in rows], np.float64), np.array([r["fold"] for r in rows], np.int64))


ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "chance": "double", "kept": "boolean"}


def judge(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds the base counts, base_failed, the calibrated chance of label 1 and kept."""
    if clash := [c for c in ADDED if c in df.columns]:
        raise ValueError(f"the input already has columns {clash}")
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _batch.buffers(batch.column(text))
            for lo, hi in _batch.slices(at):
                w = Words(data, at, lo, hi)
                h = w.hashes()
                base = _stats.base_counts(w, h)
                n = base["n_words"]
                failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
                chance = sigmoid(model.slope * logits(w, h, model) + model.shift)
                added = [base[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [failed, chance, ~failed & (chance >= KEEP)]
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, added)], names=[*own.schema.names, *ADDED])

    return df.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), train(docs, labels))
