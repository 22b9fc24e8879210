"""Per-text counts and shares over Arrow batches, and the labelled rows that classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _batch
from millrace.llm._batch import Words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_IS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "pipe": np.arange(256) == ord("|"),
    "mark": np.isin(np.arange(256), np.array(list(b"#*$%&<>@{}[]\\^~=_+/"))),
    "bang": np.isin(np.arange(256), np.array(list(b"!?"))),
    "stop": np.isin(np.arange(256), np.array(list(b".,;:"))),
    "wide": np.arange(256) >= 0xC0,
}
_LINE = _batch._RNG.randint(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LINE[10] = 0


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set between consecutive places of ``at``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: entries equal to an earlier one of the same owner; entries that occur twice or more."""
    order = np.lexsort((hashes, owner))
    later = np.zeros(len(order), bool)
    if len(order) > 1:
        same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        later[1:] = same
        shared = later.copy()
        shared[:-1] |= same
    else:
        shared = later.copy()
    first, many = np.zeros_like(later), np.zeros_like(later)
    first[order], many[order] = later, shared  # lexsort is stable, so the first of equals is the earliest
    return first, many


def base_counts(w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines per row."""
    rows = len(w.count)
    starts_char = (w.data & 0xC0) != 0x80
    out = {"n_words": w.count.astype(np.int64), "word_chars": per_row(w.inside & starts_char, w.at), "n_symbols": per_row(SYMBOLS[w.data], w.at)}
    # lines with a word
    breaks = np.flatnonzero(w.data == 10) + 1
    begins = np.unique(np.concatenate([w.at[:-1], breaks]))
    begins = begins[begins < len(w.data)]
    out["n_dup_lines"], out["n_lines"] = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(begins):
        with np.errstate(over="ignore"):
            n = len(w.data)
            hashes = _batch.mix(np.add.reduceat(_LINE[w.data] * _batch._power(n, "mul", _batch._MUL), begins) * _batch._power(n, "inv", _batch._INV)[begins])
        ends = np.append(begins[1:], n)
        worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
        owner = np.searchsorted(w.at, begins, "right") - 1
        owner, hashes = owner[worded], hashes[worded]
        dup, _ = repeats(owner, hashes)
        out["n_dup_lines"] = np.bincount(owner[dup], minlength=rows).astype(np.int64)
        out["n_lines"] = np.bincount(owner, minlength=rows).astype(np.int64)
    # words in 8-word windows found twice or more
    found, where = w.windows(8, h)
    covered = np.zeros(len(h) + 9, np.int64)
    if len(found):
        _, many = repeats(np.searchsorted(w.first, where, "right") - 1, found)
        np.add.at(covered, where[many], 1)
        np.add.at(covered, where[many] + 8, -1)
    out["n_repeat_words"] = per_row(np.cumsum(covered)[: len(h)] > 0, w.first)
    return out


STATS = (
    "log_chars", "log_words", "word_length", "symbols", "upper", "digit", "pipe", "mark", "bang", "stop", "wide", "space",
    "dup_lines", "repeat_words", "distinct_words", "twice_running", "repeat_pairs", "line_words", "long_words", "one_letter",
)


def statistics(w: Words) -> np.ndarray:
    """rows x len(STATS) float32; zeros for empty texts."""
    h = w.hashes()
    base = base_counts(w, h)
    rows = len(w.count)
    size = np.diff(w.at).astype(np.float64)
    chars, words = np.maximum(size, 1), np.maximum(w.count, 1).astype(np.float64)
    owner = np.repeat(np.arange(rows), w.count)
    again, _ = repeats(owner, h)
    running = np.zeros(len(h), bool)
    if len(h) > 1:
        running[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    pairs, where = w.windows(2, h)
    pair_again, _ = repeats(owner[where], pairs) if len(where) else (np.zeros(0, bool), None)
    lengths = w.ends - w.starts
    count = lambda flags: np.bincount(owner[flags], minlength=rows) / words
    cols = {
        "log_chars": np.log1p(size), "log_words": np.log1p(w.count), "word_length": np.bincount(owner, lengths, rows) / words,
        "symbols": base["n_symbols"] / chars, "space": per_row(_batch.SPACE[w.data], w.at) / chars,
        "dup_lines": base["n_dup_lines"] / np.maximum(base["n_lines"], 1), "repeat_words": base["n_repeat_words"] / words,
        "distinct_words": 1 - count(again), "twice_running": count(running), "repeat_pairs": np.bincount(owner[where][pair_again], minlength=rows) / words,
        "line_words": w.count / np.maximum(base["n_lines"], 1), "long_words": count(lengths > 18), "one_letter": count(lengths == 1),
    } | {k: per_row(flags[w.data], w.at) / chars for k, flags in _IS.items()}
    return np.stack([np.asarray(cols[k], np.float32) for k in STATS], 1)


def held_out(doc_id: Column) -> Column:
    """The rows no classifier may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def one_text(docs: DataFrame, y: DataFrame) -> DataFrame:
    """(doc_id, text, and y's columns): for each id of ``y``, a short table of distinct ids, the smallest of its texts."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
    return texts.groupBy("doc_id", *[c for c in y.columns if c != "doc_id"]).agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, y, fold): at most ``bound`` labelled rows outside the held-out ones, chosen by a hash of the id.

    Contradicting or repeated labels of an id count once, as the smallest, and so do rows that repeat an id; null labels
    and ids are left out.
    """
    y = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    y = y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    y = y.withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"))
    return one_text(docs, y)  # at most `bound` rows
