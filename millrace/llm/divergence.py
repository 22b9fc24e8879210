"""Source divergence audit: how far the sources of a language are apart in their words, and which words tell a source.

Each language keeps the terms that stand in at least MIN_DOCS of its documents. A group (language, source) gives each
kept term the smoothed share p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), and f = floor((p - q)^2 / (p + q)) compares
two shares. The kept terms of a language are dealt to blocks, its sources to bands; one task has two bands and one block
as dense int64 matrices, compares all pairs of their rows at once by broadcasting, and gives a partial matrix of pairs
and the ten strongest terms of each group. Partial matrices are added up, the heaps merged.

Null text, language and source count as ''. Rows that repeat are counted as often as they stand there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._spark import Shelf, among

MIN_DOCS = 10
TOP = 10  #: terms listed for each group
BAND = 48  #: groups in a band
BLOCK = 512  #: kept terms in a block, about
SCALE = 1_000_000_000
ENTRIES = 1 << 18  #: counts held in a worker before they go out
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_MANY = 1 << 20  #: bytes of text matched at once


def _terms(text: str, many: int = _MANY) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length; only A-Z become small letters."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    if len(data) <= many:
        yield _TERM.findall(data)
        return
    found = _TERM.finditer(data)
    while part := [m.group() for m in islice(found, many // 4)]:
        yield part


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and documents, counted in the workers, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in have.items():
                terms = [t.decode("utf-8", "surrogatepass") for t in n]
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(terms, pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            have.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = have.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in _terms(text):
                    n.update(part)
                    seen.update(part)
                docs.update(seen)
            if sum(len(n) for n, _ in have.values()) > ENTRIES:
                yield from out()
        yield from out()

    got = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact: three digits at a time stay within 64 bits up to 9 * 10^15 words."""
    by = total + 2 * terms
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, by.shape), np.int64), counts + 2
    for _ in range(4):  # the whole part first, then nine digits
        part, rest = rest // by, rest % by * 1000
        out = out * 1000 + part
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


TILE = "part string, lang string, a long, b long, term string, value long"
CELL = "lang string, band_a int, band_b int, block int, term string, n long, of long, idx long"


def _tile(table: pa.Table, size: int, step: int) -> pa.Table:
    """One block of terms for two bands of groups.

    Rows: a count (term, n of a group idx, of: the language's), a term that may stand in other bands only (idx 0), a group
    (no term, n: its N, of: the language's V, its idx), and the language (no term, n: its N, of: its V, idx 0).
    """
    lang, first, second = (table.column(c)[0].as_py() for c in ("lang", "band_a", "band_b"))
    known = table.column("term").is_valid().to_numpy(zero_copy_only=False)
    idx, n, of = (table.column(c).to_numpy() for c in ("idx", "n", "of"))
    whole = int(np.flatnonzero(~known & (idx == 0))[0])
    lang_total, kept = n[whole], int(of[whole])
    member = ~known & (idx > 0)
    order = np.argsort(idx[member])
    groups, totals = idx[member][order], n[member][order]
    words = table.column("term").filter(pa.array(known)).to_pylist()
    terms = sorted(set(words))  # by code points, which is the order of UTF-8
    column = {t: i for i, t in enumerate(terms)}
    counts, overall = np.zeros((len(groups), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    where = np.array([column[w] for w in words], np.int64)
    overall[where] = of[known]
    own = idx[known] > 0
    counts[np.searchsorted(groups, idx[known][own]), where[own]] = n[known][own]
    band = (groups - 1) // size
    mine, others = np.flatnonzero(band == first), np.flatnonzero(band == second)
    sums = np.zeros((len(mine), len(others)), np.int64)
    strongest: dict[int, list] = {g: [] for g in mine.tolist()}
    for lo in range(0, len(terms), step):
        p = shares(counts[:, lo : lo + step], totals[:, None], kept)
        sums += divergence(p[mine][:, None, :], p[others][None, :, :]).sum(2)
        if first == second:
            q = shares(overall[lo : lo + step], np.array(lang_total), kept)
            f = divergence(p, q[None, :])
            told = (counts[:, lo : lo + step] > 0) & (p > q[None, :])
            for g in mine.tolist():
                at = np.flatnonzero(told[g])
                best = at[np.argsort(-f[g, at], kind="stable")[:TOP]]  # stable: ties stay in the order of terms
                strongest[g] += [(-int(f[g, i]), terms[lo + i]) for i in best.tolist()]
    rows = [("term", lang, int(groups[g]), 0, t, -v) for g, found in strongest.items() for v, t in sorted(found)[:TOP]]
    pairs = [(i, j) for i in range(len(mine)) for j in range(len(others)) if groups[mine[i]] < groups[others[j]]]
    rows += [("pair", lang, int(groups[mine[i]]), int(groups[others[j]]), None, int(sums[i, j])) for i, j in pairs]
    names = [c.split()[0] for c in TILE.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of ``docs`` (text, lang, source).

    part ``pair``: every other source of the language and the sum of f over all kept terms, 0 where none is kept;
    part ``term``: the terms a group uses more than its language does, the ten with the largest f. Ranks count from 1 by
    falling value, then by item. A language with one source has no pairs; an empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = shelf.put(term_counts(clean))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of")).where(F.col("docs") >= min_docs).select("lang", "term", "of")
    kept = shelf.put(kept)
    counts = shelf.put(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of").alias("total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = clean.select("lang", "source").distinct().withColumn("idx", place).join(totals, ["lang", "source"], "left")
    groups = groups.join(langs.withColumnRenamed("total", "lang_total"), "lang", "left").fillna(0, ["total", "v", "lang_total"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int")
    groups = shelf.put(groups.withColumn("blocks", blocks).withColumn("bands", F.ceil(F.max("idx").over(Window.partitionBy("lang")) / band).cast("int")))
    shelf.drop(found)

    to_block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    own_band = ((F.col("idx") - 1) / band).cast("int")
    facing = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda j: F.struct(F.least(own_band, j).alias("a"), F.greatest(own_band, j).alias("b")))
    cell = [F.col("lang"), F.col("pair.a").alias("band_a"), F.col("pair.b").alias("band_b"), F.col("block")]
    data = among(counts, groups.select("lang", "source", "idx", "blocks", "bands"), ["lang", "source"])
    data = data.withColumn("block", to_block).withColumn("pair", F.explode(facing)).select(*cell, "term", "n", "of", "idx")
    member = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pair", F.explode(facing))
    nothing = F.lit(None).cast("string").alias("term")
    member = member.select(*cell, nothing, F.col("total").alias("n"), F.col("v").alias("of"), "idx").unionByName(member.select(*cell, nothing, F.col("lang_total").alias("n"), F.col("v").alias("of"), F.lit(0).cast("long").alias("idx")).distinct())
    # of several bands, two may lack a term that others have; their shares of it still differ
    many = groups.where("bands > 1")
    facing_all = F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda j: F.struct(i.alias("a"), j.alias("b"))))), lambda x: x["a"] <= x["b"]))
    lacking = among(kept, many.select("lang", "blocks", "bands").distinct(), "lang").withColumn("block", to_block).withColumn("pair", facing_all)
    data = data.unionByName(lacking.select(*cell, "term", F.lit(0).cast("long").alias("n"), "of", F.lit(0).cast("long").alias("idx")))
    tiles = shelf.put(data.unionByName(member).groupBy("lang", "band_a", "band_b", "block").applyInArrow(lambda table: _tile(table, band, block), TILE))
    shelf.drop(counts, kept)

    names = groups.select("lang", "idx", "source")
    name = lambda df, at, out: among(df, names.select("lang", F.col("idx").alias(at), F.col("source").alias(out)), ["lang", at])
    sums = tiles.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = name(name(sums, "a", "left"), "b", "right")
    sides = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item"))))
    pairs = sums.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = name(tiles.where("part = 'term'"), "a", "source").select("lang", "source", "part", F.col("term").alias("item"), "value")
    by = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    ranked = lambda df: df.withColumn("rank", by)
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}
), v AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (
    SELECT DISTINCT lang, source FROM d
), cells AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, kept.n AS of, v.v, v.total
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
    SELECT lang, source, term, n, 1 + {SCALE} * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p, 1 + {SCALE} * (of + 2) // (total + 2 * v) AS q FROM cells
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= {TOP}
"""
