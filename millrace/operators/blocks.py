"""Pages parsed into addressable blocks: one narrow pass over each page's lines, in Arrow batches, without a shuffle.

A page is one row, so its blocks, their order and the numbers that tell equal ones apart are known inside the row. A
block is placed by (closers, phase, line, column): blank lines, table rows, items and headings close what was open; in the
stretch between two closers all paragraphs come in line order, then the one quote that the stretch's quote lines make.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.udfs import MARKS, inline

# The line forms of the Markdown dialect.
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"\s*(?:```|~~~)")
TABLE_RULE = re.compile(r"\s*\|[\s:|-]+\|\s*$")
LINE = re.compile(r"(?P<blank>\s*$)|\s*(?P<table>\|.*)|\s*>\s?(?P<quote>.*)|(?P<indent>\s*)(?:[-*+]|(?P<ordinal>\d+[.)]))\s+(?P<li>.*)|(?P<para>.*)")

BLOCK = T.StructType([T.StructField(name, kind) for name, kind in (
    ("ord", T.IntegerType()), ("block_id", T.StringType()), ("kind", T.StringType()), ("level", T.IntegerType()), ("path", T.ArrayType(T.StringType())),
    ("plain", T.StringType()), ("raw", T.StringType()), ("marks", MARKS["marks"].dataType), ("line", T.IntegerType()), ("depth", T.IntegerType()),
    ("ordered", T.BooleanType()), ("row", T.IntegerType()), ("col", T.IntegerType()), ("occurrence", T.IntegerType()),
)])
BATCH = 20_000  #: blocks sent back at once


def block_id(page: str, path: list[str], plain: str, occurrence: int) -> str:
    """12 hex digits that stay while the page's other blocks change."""
    return hashlib.blake2s("\0".join((page, " > ".join(path), plain, str(occurrence))).encode(), digest_size=6).hexdigest()


def placed(text: str) -> list[tuple]:
    """((closers, phase, line, col), kind, raw, level, path, depth, ordered, row) of a page, in order; blank ones too."""
    found, path, level, closers, row, fenced, quote = [], [], 0, 0, 0, False, None
    for n, line in enumerate(text.split("\n")):
        fence = FENCE.match(line)
        fenced ^= bool(fence)
        heading = None if fenced or fence else HEADING.match(line)
        form = LINE.match(line)
        kind = "heading" if heading else form.lastgroup
        if kind not in ("para", "quote"):
            closers, quote = closers + 1, None
        if heading:
            level, row = len(heading[1]), 0
            path = [(k, t) for k, t in path if k < level] + [(level, heading[2])]
            found.append(((closers, 0, n, 0), kind, heading[2], level, path, 0, False, None))
        elif kind == "blank":
            row = 0
        elif kind == "table":
            if not TABLE_RULE.match(line):
                found += [((closers, 0, n, c), "cell", cell.strip(), level, path, 0, False, row) for c, cell in enumerate(line.strip().strip("|").split("|"))]
                row += 1
        elif kind == "quote":
            if quote is None:
                quote = []
                found.append(((closers, 2, n, 0), kind, quote, level, path, 0, False, None))
            quote.append(form["quote"].strip())
        elif kind == "li":
            found.append(((closers, 0, n, 0), kind, form["li"].strip(), level, path, len(form["indent"]) // 2, form["ordinal"] is not None, None))
        else:
            found.append(((closers, 1, n, 0), kind, line.strip(), level, path, 0, False, None))
    return sorted(found, key=lambda f: f[0])


def page_blocks(page: str, text: str) -> Iterator[tuple]:
    """The fields of BLOCK for every block that shows any text."""
    seen: Counter = Counter()
    order = 0
    for (_, _, line, col), kind, raw, level, path, depth, ordered, row in placed(text):
        raw = raw if isinstance(raw, str) else " ".join(raw)
        plain, marks = inline(raw)
        if not plain.strip():
            continue
        titles = [t for _, t in path]
        key = (" > ".join(titles), plain)
        again = seen[key]
        seen[key] += 1
        marks = [dict(zip(("start", "end", "kind", "href"), m, strict=True)) for m in marks]
        yield order, block_id(page, titles, plain, again), kind, level, titles, plain, raw, marks, line, depth, ordered, row, col if kind == "cell" else None, again
        order += 1


def parse(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """(key and BLOCK) of whole pages: headings, paragraphs, list items, table cells and quotes with plain text, marks and ids.

    Null pages have no blocks. Rows of one key are parsed on their own. The key, as text, is part of each id.
    """
    schema = T.StructType([pages.schema[key], *BLOCK.fields])
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, body in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                for block in () if body is None else page_blocks(str(page), body):
                    rows.append((page, *block))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)
                        rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    return pages.select(key, text).mapInArrow(run, schema)


NODE = T.StructType([T.StructField(name, kind) for name, kind in (
    ("line", T.IntegerType()), ("level", T.IntegerType()), ("title", T.StringType()), ("path", T.ArrayType(T.StringType())), ("trail", T.ArrayType(T.IntegerType())), ("body", T.StringType()),
)])


def page_nodes(text: str) -> Iterator[tuple]:
    """The fields of NODE for every heading of a page; trail: the lines of the path's headings, body: the lines up to the next heading, stripped."""
    lines, fenced, heads = text.split("\n"), False, []
    for n, line in enumerate(lines):
        fence = FENCE.match(line)
        fenced ^= bool(fence)
        if not (fenced or fence) and (m := HEADING.match(line)):
            heads.append((n, len(m[1]), m[2]))
    trail: list[tuple[int, int, str]] = []
    ends = [n for n, _, _ in heads[1:]] + [len(lines)]
    for (n, level, title), end in zip(heads, ends, strict=False):  # without headings there is an end too many
        trail = [h for h in trail if h[1] < level] + [(n, level, title)]
        yield n, level, title, [h[2] for h in trail], [h[0] for h in trail], "\n".join(lines[n + 1 : end]).strip()


def nodes(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """(key and NODE) of the headings of whole pages, inside each page's row."""
    schema = T.StructType([pages.schema[key], *NODE.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, body in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                rows += [(page, *node) for node in page_nodes(body or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return pages.select(key, text).mapInArrow(run, schema)


def lock(blocks: DataFrame, key: str = "page") -> DataFrame:
    """(key, blocks, digest): what a page's blocks say, marks and places included, in one digest a page."""
    mark = F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["start"], m["end"], m["kind"], F.coalesce(m["href"], F.lit("")))), ",")
    said = F.concat_ws("\x1f", "block_id", "kind", F.col("level").cast("string"), "plain", mark)
    got = blocks.groupBy(key).agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("ord", said.alias("s")))).alias("b"))
    return got.select(key, "blocks", F.sha2(F.array_join(F.transform("b", lambda b: b["s"]), "\x1e"), 256).alias("digest"))


def lock_changes(stored: DataFrame, now: DataFrame, key: str = "page") -> DataFrame:
    """(key, state): pages whose block lock is ``new``, ``gone`` or ``stale``; none where all locks hold."""
    both = stored.select(key, F.col("digest").alias("was")).join(now.select(key, F.col("digest").alias("is")), key, "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "stale")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")
