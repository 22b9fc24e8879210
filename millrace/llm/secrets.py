"""Secret scans: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

Candidates are runs of at least WINDOW token characters. For each character class of CLASSES, runs of that class are
walked with a window whose character counts, and with them the sum of c * log2(c), are kept up to date one step at a
time; windows at or above the class's entropy that hold letters and digits, or at least MIXED letters of either case,
are joined into a stretch. Pattern spans are never suppressed, and are cut out of a stretch: what is left on either side
is a span where it has WINDOW characters. A stretch inside another span is left out, one that is wider is a span too.

The allow list: a span that is all words, paths, dates or numbers, where no window mixes cases, and a stretch whose
every window touches a filler (``example``, ``0000``, ...); one window clear of fillers is enough for the whole stretch.

Defined results: null or empty text has no spans; spans are code points, end exclusive; repeated rows stay; an empty
table gives no rows; scan() passes further columns on and refuses an input that already has a column ``spans``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._spark import small_batches

# The patterns, the least sizes and the order of kinds.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 20
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]{20,}"), 3.6),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.8),
)
ALLOWED = re.compile(r"[a-z_.-]+|[0-9_./-]+|(?:[a-z]+[-_./])+[a-z]+[0-9]{0,4}", re.I)
FILLER = re.compile(r"example|sample|dummy|placeholder|redacted|xxxx|0000|1234567", re.I)
MIXED = 5
_TERM = [0.0, *[c * math.log2(c) for c in range(1, WINDOW + 1)]]
_BITS = math.log2(WINDOW)


def windows(run: str, least: float) -> Iterator[tuple[int, int]]:
    """Maximal stretches of ``run`` covered by windows of at least ``least`` bits a character that mix kinds of characters."""
    for a, b, _, _ in stretches(run, least):
        yield a, b


def stretches(run: str, least: float) -> Iterator[tuple[int, int, bool, bool]]:
    """The same with two marks: whether a window mixes cases, and whether one touches no filler."""
    fillers = [m.span() for m in FILLER.finditer(run)]
    counts: dict[str, int] = {}
    total, digits, letters, upper, begun, ended, near = 0.0, 0, 0, 0, -1, -1, 0
    mixes = clear = False
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        digits += c.isdigit()
        letters += c.isalpha()
        upper += c.isupper()
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total -= _TERM[n] - _TERM[n - 1]
            digits -= gone.isdigit()
            letters -= gone.isalpha()
            upper -= gone.isupper()
        if i < WINDOW - 1 or _BITS - total / WINDOW < least:
            continue
        mixed = upper >= MIXED and letters - upper >= MIXED
        if mixed or (digits and letters):
            lo = i - WINDOW + 1
            if begun >= 0 and lo > ended:
                yield begun, ended, mixes, clear
                begun = -1
            if begun < 0:
                begun, mixes, clear = lo, False, False
            ended = i + 1
            mixes = mixes or mixed
            while near < len(fillers) and fillers[near][0] <= i:
                near += 1
            clear = clear or not near or fillers[near - 1][1] <= lo
    if begun >= 0:
        yield begun, ended, mixes, clear


class Union:
    """Disjoint stretches that cover the given spans, for searches by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for x, y in sorted(spans):
            if self.ends and x <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], y)
            else:
                self.starts.append(x)
                self.ends.append(y)

    def outside(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """The parts of [lo, hi) that are not covered."""
        k = bisect.bisect_right(self.ends, lo)
        while k < len(self.starts) and self.starts[k] < hi:
            yield lo, self.starts[k]
            lo = self.ends[k]
            k += 1
        yield lo, hi


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number), by start, then kind."""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    base = Union([(a, b) for a, b, _ in found])
    for m in RUN.finditer(text):
        run, off = m.group(), m.start()
        if run.isalpha() and run[1:].islower():
            continue
        starts: list[int] = []  # of the spans of earlier classes, with the furthest end so far
        reach: list[int] = []
        for number, (_, shape, least) in enumerate(CLASSES, 3):
            own = []
            for piece in shape.finditer(run):
                for a, b, mixes, clear in stretches(piece.group(), least):
                    if not clear:
                        continue
                    for x, y in base.outside(off + piece.start() + a, off + piece.start() + b):
                        k = bisect.bisect_right(starts, x) - 1
                        if y - x >= WINDOW and not (k >= 0 and reach[k] >= y) and (mixes or not ALLOWED.fullmatch(text[x:y])):
                            own.append((x, y))
                            found.append((x, y, number))
            if own:
                both = sorted([*zip(starts, reach, strict=True), *own])
                starts = [x for x, _ in both]
                reach = list(itertools.accumulate((y for _, y in both), max))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, text: str = "text", redact: bool = False, mask: str = "[SECRET]") -> DataFrame:
    """Adds ``spans``; with ``redact``, found stretches of ``text`` (overlapping ones as one) give way to ``mask``."""
    if "spans" in df.columns:
        raise ValueError("the input already has a column spans")
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.schema.names, list(batch.columns)
            texts = batch.column(text).to_pylist()
            found = [spans_of(x) if x else [] for x in texts]
            if redact:
                kind = batch.schema.field(text).type
                columns[names.index(text)] = pa.array([masked(x, s, mask) if s else x for x, s in zip(texts, found, strict=True)], kind)
            spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in found], _ARROW)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, "spans"])

    return df.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans if k < 3).encode()).hexdigest()
