"""Texts that a record holds, placed on the page they came from: canonical search, and entries that are claimed once.

A record keeps a statement in canonical form (plain quotes and hyphens, single blanks); a block keeps the page's own
characters. The block is folded character by character, so places in the folded text are places in the block, and the
needle becomes a pattern in which a blank stands for any run of them. No place is ever mapped back by a table.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions import text as X
from millrace.operators.blocks import page_blocks


def folded(text: Column) -> Column:
    """Typography made plain and every white space a blank, one character for one."""
    return F.translate(F.regexp_replace(text, r"(?U)\s", " "), "’‘“”‑‐", "''\"\"--")


def canonical_hit(block: Column, needle: Column) -> Column:
    """struct<start, end>: where a block first says the needle, in the block's own code points; null where it doesn't or nothing is asked."""
    want = X.normalise_statement(needle)
    quoted = F.replace(F.replace(want, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E +\\Q"))
    form = F.concat(F.lit("(?s)^(.*?)(\\Q"), quoted, F.lit("\\E)"))
    part = lambda k: F.length(F.call_function("regexp_extract", folded(block), form, F.lit(k)))
    return F.when((want != "") & (part(2) > 0), F.struct(part(1).alias("start"), (part(1) + part(2)).alias("end")))


_FOLD = {ord(c): p for c, p in zip("’‘“”‑‐", "''\"\"--", strict=True)} | {c: " " for c in range(0x3001) if chr(c).isspace()}
_LONG = 20_000  #: characters; on a longer page a needle meets only blocks with its longest inner word


class PageText:
    """The blocks of one page, searched for canonical needles."""

    def __init__(self, blocks: list[tuple]):
        """blocks: (block, path, plain), in order."""
        self.blocks = [(block, path or [], plain.translate(_FOLD)) for block, path, plain in blocks if plain is not None]
        self.texts = [re.sub(" +", " ", folded) for _, _, folded in self.blocks]
        self.whole = "\n".join(self.texts)
        self.starts = list(accumulate((len(t) + 1 for t in self.texts), initial=0))
        self.met: dict[str, int] = {}

    @functools.cached_property
    def words(self) -> dict[str, list[int]]:
        at: dict[str, list[int]] = defaultdict(list)
        for k, text in enumerate(self.texts):
            for w in set(text.split(" ")):
                at[w].append(k)
        return at

    def _first(self, want: str) -> int:
        """The first block that says it, or -1."""
        if want not in self.met:
            inner = max(want.split(" ")[1:-1], key=len, default="") if len(self.whole) > _LONG else ""
            if inner:
                self.met[want] = next((k for k in self.words.get(inner, ()) if want in self.texts[k]), -1)
            else:
                at = self.whole.find(want)
                self.met[want] = at if at < 0 else bisect_right(self.starts, at) - 1
        return self.met[want]

    def find(self, needle: str, section: list | None) -> tuple | None:
        """(block, start, end) of the first block of the section, else of the page, that says the needle."""
        want = " ".join(needle.translate(_FOLD).split())
        k = self._first(want) if want else -1
        if k < 0:
            return None
        if section is not None:
            k = next((n for n, (_, path, _) in enumerate(self.blocks) if path[: len(section)] == section and want in self.texts[n]), k)
        block, _, folded = self.blocks[k]
        if len(folded) == len(self.texts[k]):
            start = folded.index(want)
            return block, start, start + len(want)
        m = re.search(" +".join(map(re.escape, want.split(" "))), folded)
        return block, m.start(), m.end()

    def place(self, text: str | None, section: list | None) -> list[tuple]:
        """(line, block, start, end) of each line of a text that shows anything; nothing unless all are found."""
        out = []
        for n, part in enumerate((text or "").split("\n")):
            if part.strip():
                hit = self.find(part, section) or self.find(" ".join(b[5] for b in page_blocks("", part)), section)
                if hit is None:
                    return []
                out.append((n, *hit))
        return out


def located(strings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, sid, parts): where each line of a string stands; an empty list unless all its lines are found.

    strings: page, sid, text, section (a heading path, may be null); blocks: page, block, ord, path, plain. A line is looked
    for as it is and then without its marks, first in the string's section, then on the whole page; the first block counts.
    parts: line, block, start, end. Blocks and strings meet once, dealt by page and sorted; a worker holds the blocks of one
    page. Blocks have one row for each page and ord.
    """
    of, ids, rank = blocks.schema["block"].dataType, strings.schema["sid"].dataType, blocks.schema["ord"].dataType
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = blocks.select("page", F.lit(0).alias("what"), "ord", F.col("plain").alias("text"), F.col("path").alias("section"), "block", none(ids, "sid"))
    rows = rows.unionByName(strings.select("page", F.lit(1).alias("what"), none(rank, "ord"), "text", "section", none(of, "block"), "sid"))
    part = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("block", of), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([T.StructField("page", strings.schema["page"].dataType), T.StructField("sid", ids), T.StructField("parts", T.ArrayType(part))])
    schema, names = to_arrow_schema(out), part.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for page, rows in groupby(each, lambda r: r[0]):
            held, text, found = [], None, []
            for _, what, _, said, path, block, sid in rows:
                if not what:
                    held.append((block, path, said))
                else:
                    text = text or PageText(held if page is not None else [])
                    found.append((sid, [dict(zip(names, p, strict=True)) for p in text.place(said, path)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([page] * len(found), [f[0] for f in found], [f[1] for f in found]), schema, strict=True)], schema=schema)

    return rows.repartition("page").sortWithinPartitions("page", "what", "ord").mapInArrow(search, out)


def claimed(strings: DataFrame, entries: DataFrame, keys: list[str], canonical=X.normalise_statement) -> DataFrame:
    """(keys, n, e, how): which entry each string came from, every entry claimed once before any is claimed again.

    strings: keys, n, text; entries: keys, e, text; n and e give the order. The k-th string of a text takes the k-th entry of
    it (``exact``); of those left over, the k-th string of a canonical form takes the k-th entry of it (``canonical``); a
    string for which no entry is free shares the first that has its text, else its form (``shared``). The rest have no
    entry (e null, ``none``), and entries that no string has come without a string (n null, ``unclaimed``).
    """

    def numbered(rows: DataFrame, order: str, by: str) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, by).orderBy(order)))

    brief = lambda c: F.unhex(F.md5(c))  # noqa: E731  texts are only compared: digests of 16 bytes are joined in their place
    told = lambda rows, order: rows.select(*keys, order, brief(F.col("text")).alias("text"), brief(canonical(F.col("text"))).alias("form"))
    s, t = told(strings, "n"), told(entries, "e")
    exact = numbered(s, "n", "text").join(numbered(t, "e", "text").select(*keys, "text", "k", "e", F.col("form").alias("e_form")), [*keys, "text", "k"], "full_outer")
    taken = exact.where("n IS NOT NULL AND e IS NOT NULL").select(*keys, "n", "e", F.lit("exact").alias("how"))
    left_s = exact.where("e IS NULL").select(*keys, "n", "text", "form")
    left_t = exact.where("n IS NULL").select(*keys, "e", F.col("e_form").alias("form"))
    loose = numbered(left_s, "n", "form").join(numbered(left_t, "e", "form"), [*keys, "form", "k"], "full_outer")
    alike = loose.where("n IS NOT NULL AND e IS NOT NULL").select(*keys, "n", "e", F.lit("canonical").alias("how"))
    bare = loose.where("e IS NULL").select(*keys, "n", "text", "form")
    first = lambda by, name: t.groupBy(*keys, by).agg(F.min("e").alias(name))
    rest = bare.join(first("text", "e0"), [*keys, "text"], "left").join(first("form", "e1"), [*keys, "form"], "left").withColumn("e", F.coalesce("e0", "e1"))
    rest = rest.select(*keys, "n", "e", F.when(F.col("e").isNull(), "none").otherwise("shared").alias("how"))
    unclaimed = loose.where("n IS NULL").select(*keys, "n", "e", F.lit("unclaimed").alias("how"))
    return taken.unionByName(alike).unionByName(rest).unionByName(unclaimed)


def placed_examples(strings: DataFrame, spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rule, kind, n, text, how, parts): each example a rule lists, with its place; and examples that only spans have.

    strings: page, rule, kind, n, text, section; spans: rule, kind, e, text, parts. how: span (an example span has it), text
    (found on the page), none, or span_only, which have no n.
    """
    keys = ["rule", "kind"]
    got = claimed(strings, spans, keys)
    parts = spans.select(*keys, "e", F.col("text").alias("span_text"), "parts")
    rows = got.join(strings.select(*keys, "n", "page", "text", "section"), [*keys, "n"], "left").join(parts, [*keys, "e"], "left")
    sid = F.struct("rule", "kind", "n")
    loose = rows.where("e IS NULL").select("page", sid.alias("sid"), "text", "section")
    on_page = located(loose, blocks).select(F.col("sid.rule").alias("rule"), F.col("sid.kind").alias("kind"), F.col("sid.n").alias("n"), F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["start"].alias("start"), p["end"].alias("end"))).alias("found"))
    rows = rows.join(on_page, [*keys, "n"], "left")
    how = F.when(F.col("how") == "unclaimed", "span_only").when(F.col("e").isNotNull(), "span").when(F.size("found") > 0, "text").otherwise("none")
    return rows.select(*keys, "n", F.coalesce("text", "span_text").alias("text"), how.alias("how"), F.coalesce("parts", "found").alias("parts"))
