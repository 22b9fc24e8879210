"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from the statistics of at most LABELLED labelled rows (about 20 numbers each); they
are complete, so level by level they are flat arrays of feature and threshold, and scoring is a handful of numpy
gathers per tree for a whole Arrow batch. Labels, language, source and id are never inputs.

Defined results: null text is scored as the empty text; without any label, or with labels of one kind only, every
score is the labels' mean (0.5 without any); repeated rows stay; an empty table gives no rows; score() passes further
columns on and refuses an input that already has a column ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _batch, _stats
from millrace.llm._spark import small_batches

LABELLED = 12_000  #: bound of the labelled rows learned from
TREES, DEPTH, BINS, RATE, LEAF, L2 = 80, 4, 32, 0.15, 10, 1.0
THRESHOLD = 0.7


@dataclass
class Forest:
    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y):
        return none
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    none.start = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")).astype(np.float32) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    n, width = x.shape
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, none.start)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, cl = sums
            gt, ht, ct = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(cl < LEAF) | (ct - cl < LEAF)] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        slot = node - inner
        value = -RATE * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + L2)
        margin += value[slot]
        features.append(feature), cuts.append(cut), values.append(value)
    return Forest(none.start, np.array(features), np.array(cuts), np.array(values))


def _with_stats(df: DataFrame) -> DataFrame:
    """(y, stats): the statistics of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _batch.buffers(batch.column("text"))
            for lo, hi in _batch.slices(at):
                x = _stats.statistics(_batch.Words(data, at, lo, hi))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "stats"])

    return df.select("y", "text").mapInArrow(run, "y int, stats binary")


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Forest:
    rows = _with_stats(_stats.labelled(docs, labels, "quality", bound)).collect()  # at most `bound` short rows
    rows.sort(key=lambda r: (bytes(r["stats"]), r["y"]))
    x = np.frombuffer(b"".join(bytes(r["stats"]) for r in rows), np.float32).reshape(-1, len(_stats.STATS))
    return grow(x, np.array([r["y"] for r in rows], np.float64))


def score(df: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """Adds ``score``: the chance that the text's label is 1."""
    if "score" in df.columns:
        raise ValueError("the input already has a column score")
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _batch.buffers(batch.column(text))
            parts = [forest.score(_stats.statistics(_batch.Words(data, at, lo, hi))) for lo, hi in _batch.slices(at)]
            got = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", _stats.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
