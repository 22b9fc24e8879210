"""What no Spark expression can say: composition, BLAKE2 digests, offsets of Python patterns, marks, repaired headings."""

from __future__ import annotations

import contextlib
import hashlib
import re
import signal
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return text.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def blake2s_hex(size: int):
    """A pandas UDF: hex BLAKE2s digest of ``size`` bytes. Digests of different sizes are unrelated."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else hashlib.blake2s(x.encode(), digest_size=size).hexdigest())

    return digest


def uid(page, path, statement):
    """16 hex digits that name a rule: page, heading path and statement, NUL between."""
    return blake2s_hex(8)(F.concat(page, F.lit("\0"), F.array_join(path, " > "), F.lit("\0"), statement))


def sweep_slice(path, slices: int = 7):
    """The slice of a path: its 4-byte digest, big-endian, modulo ``slices``."""
    return F.conv(blake2s_hex(4)(path), 16, 10).cast("long") % slices


def held_out(path):
    """One path in sixteen."""
    return F.conv(F.left(blake2s_hex(32)(path), F.lit(2)), 16, 10).cast("int") % 16 == 0


class MatcherError(ValueError):
    """A matcher that cannot be run as written."""


# Single quotation, and a term that stands alone.
_QUOTED = re.compile(r"‘[^‘’\n]{1,120}?’(?![A-Za-z])")
_ALONE = (r"(?<![\w’'-])(?:", r")(?![\w-])")


def _words(value) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) and x for x in value)


#: For each key of a matcher: what it must be, in words and as a test. Patterns must compile besides.
KEYS = {
    "pattern": ("a text", lambda v: isinstance(v, str) and v != ""), "terms": ("a list of words", lambda v: _words(v) and v != []), "unless": ("a list of texts", _words),
    "ignore_case": ("true or false", lambda v: isinstance(v, bool)), "skip_quoted": ("true or false", lambda v: isinstance(v, bool)),
    "window": ("a whole number from 0 to 200", lambda v: type(v) is int and v in range(201)),
}
METHODS = {
    "regex": {"pattern": None, "ignore_case": False, "unless": [], "window": 40, "skip_quoted": False},
    "literal_set": {"terms": None, "ignore_case": True, "unless": [], "window": 40, "skip_quoted": True},
}


def check_matcher(method: str, spec: dict) -> dict:
    """The full specification of a matcher, or MatcherError."""
    defaults = METHODS.get(method)
    if defaults is None:
        raise MatcherError(f"method {method!r} cannot be run")
    if not isinstance(spec, dict) or not spec.keys() <= defaults.keys():
        raise MatcherError(f"a {method} matcher has keys it does not know")
    full = defaults | spec
    for key, value in full.items():
        what, holds = KEYS[key]
        if not holds(value):
            raise MatcherError(f"{key} must be {what}")
    if "terms" in full:  # the longest first, so that no term hides one that begins with it
        full["pattern"] = "|".join(map(re.escape, sorted({*full["terms"]}, key=lambda t: (len(t), t), reverse=True))).join(_ALONE)
    for pattern in (full["pattern"], *full["unless"]):
        try:
            re.compile(pattern)
        except re.error as e:
            raise MatcherError(f"a pattern does not compile: {e}") from e
    return full


def compiled(full: dict):
    """text -> [(start, end)]: what the matcher finds."""
    flags = re.I if full["ignore_case"] else 0
    main, unless, reach = re.compile(full["pattern"], flags), [re.compile(u, flags) for u in full["unless"]], full["window"]

    def find(text: str) -> list[tuple[int, int]]:
        spans = [m.span() for m in main.finditer(text)]
        spans = [(a, b) for a, b in spans if b > a]
        if spans and full["skip_quoted"]:
            quoted = [m.span() for m in _QUOTED.finditer(text)]
            spans = [(a, b) for a, b in spans if not any(x <= a and b <= y for x, y in quoted)]
        if spans and unless:
            spans = [(a, b) for a, b in spans if not any(u.search(text[max(0, a - reach) : b + reach]) for u in unless)]
        return spans

    return find


FOUND = T.StructType([T.StructField("rule_uid", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("quote", T.StringType())])


def find_spans(blocks: DataFrame, matchers: list[tuple[str, str, dict]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), own: str | None = None) -> DataFrame:
    """Every span of every matcher in every block, by one pass of the Python workers over the blocks.

    With ``own``, a kept column, a block meets only the matchers that it names there.
    """
    full = [(uid_, check_matcher(method, spec)) for uid_, method, spec in matchers]
    schema = T.StructType([f for f in blocks.schema.fields if f.name in keep] + FOUND.fields)
    names = [f.name for f in schema.fields]

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(u, compiled(f)) for u, f in full]
        by_name: dict[str, list] = {}
        for u, find in finders:
            by_name.setdefault(u, []).append((u, find))
        for batch in batches:
            rule, begin, stop, quote, row = [], [], [], [], []
            owners = None if own is None else batch.column(own).to_pylist()
            for n, body in enumerate(batch.column(text).to_pylist()):
                for u, find in (finders if owners is None else by_name.get(owners[n], ())) if body else ():
                    for a, b in find(body):
                        rule.append(u), begin.append(a), stop.append(b), quote.append(body[a:b]), row.append(n)
            kept = batch.select(names[: -len(FOUND)]).take(pa.array(row, pa.int64()))
            found = [pa.array(v, f.type) for v, f in zip((rule, begin, stop, quote), list(arrow)[-len(FOUND) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *found], schema=arrow)

    return blocks.select(*dict.fromkeys([*names[: -len(FOUND)], text])).mapInArrow(run, schema)


class OverBudget(Exception):
    """A matcher that took longer over one page than it may."""


@contextlib.contextmanager
def time_budget(seconds: float) -> Iterator[None]:
    """OverBudget in the block once the time is up; a pattern's search is interrupted too. Workers run their function in the main thread."""

    def ring(signum, frame):
        raise OverBudget

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


COUNTED = T.StructType([T.StructField("rule_uid", T.StringType()), T.StructField("findings", T.LongType()), T.StructField("error", T.StringType())])


def count_findings(pages: DataFrame, matchers: list[tuple[str, str, dict]], seconds: float = 2.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, rule_uid, findings, error) of each page and matcher with findings or an error, by one pass of the workers over the pages.

    A matcher has ``seconds`` for a page. One that needs more gives an error for that page and none of its findings; other
    pages and matchers go on.
    """
    full = [(uid_, check_matcher(method, spec)) for uid_, method, spec in matchers]
    schema = T.StructType([pages.schema[key], *COUNTED.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(u, compiled(f)) for u, f in full]
        for batch in batches:
            rows = []
            for page, body in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                for u, find in finders if body else ():
                    n, error = 0, None
                    try:
                        with time_budget(seconds):
                            n = len(find(body))
                    except OverBudget:
                        error = f"over {seconds:g} s on one page"
                    if n or error:
                        rows.append({key: page, "rule_uid": u, "findings": n, "error": error})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return pages.select(key, text).mapInArrow(run, schema)


MARKS = T.StructType([T.StructField("plain", T.StringType()), T.StructField("marks", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("href", T.StringType())])))])
_TOKEN = re.compile(r"`([^`]+)`|!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^)\s]*)\)|\*\*(?=\S)(.+?)(?<=\S)\*\*|\*(?=\S)([^*]+?)(?<=\S)\*")


def inline(text: str, at: int = 0) -> tuple[str, list[tuple[int, int, str, str | None]]]:
    """Plain text of Markdown, and marks over it; delimiters without a partner stay as they are."""
    out, marks, last = [], [], 0
    here = at
    for m in _TOKEN.finditer(text):
        before = text[last : m.start()]
        out.append(before)
        here += len(before)
        code, label, href, strong, emphasis = m.groups()
        if code is not None:
            body, kind, inner = code, "code", []
        else:
            body, inner = inline(label if label is not None else strong if strong is not None else emphasis, here)
            kind = "link" if label is not None else "strong" if strong is not None else "em"
        if body:
            marks.append((here, here + len(body), kind, href if label is not None else None))
        marks += inner
        out.append(body)
        here += len(body)
        last = m.end()
    out.append(text[last:])
    return "".join(out), sorted(marks, key=lambda x: (x[0], -x[1], x[2]))


@F.udf(MARKS, useArrow=True)
def inline_marks(text: str):
    if text is None:
        return None
    plain, marks = inline(text)
    return plain, marks


# Fixed values of heading repair: the longest line taken for a heading, what ends a sentence, and labels of examples.
LONGEST_HEADING, SENTENCE_ENDS = 120, ".:;,!?…"
_LABELS = frozenset(["write this", "do this", "correct", "like this", "not this", "don't do this", "incorrect", "example", "examples", "more information"])
_ATX = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_NOT_A_HEADING = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s|^\s*(?:\||!\[|\[|>)|\[[^\]]{3,}\]\s*$|[.!?]\s+[A-Z]")


def repaired(text: str, level: int = 2) -> tuple[str, int]:
    """Section headings that lost their marks, put back; and how many.

    Nothing is done where a heading of ``level`` or above stands, or where no deeper one does. A lost heading is a short
    capitalised clause between empty lines, outside fences and outside the run of lines that follows an example's label.
    """
    lines = text.split("\n")
    marks = [_ATX.match(x) for x in lines]
    depths = [len(m[1]) for m in marks if m]
    if not depths or min(depths) <= level:
        return text, 0
    blank = [not x.strip() for x in lines]
    fenced = labelled = begun = False
    found = 0
    for i, (line, mark) in enumerate(zip(lines, marks, strict=True)):
        if re.match(r"\s*(?:```|~~~)", line):
            fenced = not fenced
        elif mark:
            labelled, begun = mark[2].strip().lower() in _LABELS, False
        elif blank[i]:
            labelled = labelled and not begun
        else:
            begun = True
            body = line.strip()
            alone = (i == 0 or blank[i - 1]) and (i + 1 == len(lines) or blank[i + 1])
            short = len(body) <= LONGEST_HEADING and body[0].isupper() and body[-1] not in SENTENCE_ENDS
            if alone and short and not (fenced or labelled or _NOT_A_HEADING.search(line)):
                lines[i] = "#" * level + " " + body
                found += 1
    return "\n".join(lines), found


@F.udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("promotions", T.IntegerType())]), useArrow=True)
def repair_headings(text: str):
    return None if text is None else repaired(text)


_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+[’']?|$)")


@F.udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])), useArrow=True)
def sentence_spans(text: str):
    """Stripped sentences with code-point offsets into the text."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        body = m.group().strip()
        if body:
            at = m.start() + m.group().index(body)
            out.append((at, at + len(body), body))
    return out
