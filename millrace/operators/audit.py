"""Audits: headings of the source against the Markdown made of it, and censuses of how headings are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.functions import text as X


def source_headings(pages: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """(key, ord, level, title, card) of the headings in the pages' source."""
    return pages.select(key, F.posexplode(H.headings_of(html)).alias("ord", "h")).select(key, "ord", "h.*")


def markdown_headings(pages: DataFrame, key: str = "page", md: str = "md") -> DataFrame:
    """(key, ord, level, title) of the headings of Markdown, line by line."""
    form = r"^(#{1,6})\s+(.*?)\s*$"
    rows = pages.select(key, F.posexplode(F.split(md, "\n")).alias("ord", "t")).where(F.col("t").rlike(form))
    return rows.select(key, "ord", F.length(F.regexp_extract("t", form, 1)).alias("level"), F.regexp_extract("t", form, 2).alias("title"))


def compared(source: DataFrame, markdown: DataFrame, key: str = "page") -> DataFrame:
    """(key, title, k, source_level, md_level, state): the two lists as multisets of titles, where the k-th meets the k-th.

    state: missing (the source alone has it), extra (the Markdown alone), level (both, at different levels) or same.
    Equal titles under one page are numbered in order, so a repeated heading that was lost once shows once.
    """

    def numbered(rows: DataFrame, level: str) -> DataFrame:
        rows = rows.withColumn("title", X.normalise_statement(F.col("title")))
        return rows.select(key, "title", F.row_number().over(Window.partitionBy(key, "title").orderBy("ord")).alias("k"), F.col("level").alias(level))

    both = numbered(source, "source_level").join(numbered(markdown, "md_level"), [key, "title", "k"], "full_outer")
    state = F.when(F.col("md_level").isNull(), "missing").when(F.col("source_level").isNull(), "extra").when(F.col("md_level") != F.col("source_level"), "level").otherwise("same")
    return both.withColumn("state", state)


def extraction(pages: DataFrame, key: str = "page", html: str = "html", md: str = "md") -> DataFrame:
    """(key, sections, cards, headings, missing, extra, levels) of every page: what conversion lost, added or moved.

    Headings in list items are cards: the Markdown has them as items, so they are counted and not missed.
    """
    source = source_headings(pages, key, html)
    cards = source.groupBy(key).agg(F.count_if(~F.col("card")).alias("sections"), F.count_if("card").alias("cards"))
    found = compared(source.where(~F.col("card")), markdown_headings(pages, key, md), key).groupBy(key)
    found = found.agg(F.count("md_level").alias("headings"), *[F.count_if(F.col("state") == s).alias(n) for s, n in (("missing", "missing"), ("extra", "extra"), ("level", "levels"))])
    return pages.select(key).join(cards, key, "left").join(found, key, "left").fillna(0)


def census(headings: DataFrame, by: list[str], title: str = "title", top: int = 40) -> DataFrame:
    """(by..., n, share, examples): counts over all, over each of ``by`` and over their combinations, with the first titles.

    Grouping sets in one pass; null stands for "all". At most ``top`` titles a group are kept, the smallest ones, and the
    merge keeps no more than that of any two parts, so no group is ever held whole.
    """
    distinct = headings.groupBy(*by, title).agg(F.count("*").alias("n"))
    small = F.slice(F.array_sort(F.collect_set(title)), 1, top)
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(title))).where(F.col("k") <= top)
    names = ranked.cube(*by).agg(small.alias("examples"), *[F.grouping(b).alias(f"__{b}") for b in by])
    counts = distinct.cube(*by).agg(F.sum("n").alias("n"), *[F.grouping(b).alias(f"__{b}") for b in by])
    total = F.sum(F.when(F.lit(True) & _all(by), F.col("n"))).over(Window.partitionBy())
    keys = [*by, *[f"__{b}" for b in by]]
    same = [counts[k].eqNullSafe(names[k]) for k in keys]
    got = counts.join(names, same).select(*[counts[k] for k in keys], "n", "examples").withColumn("share", F.round(F.col("n") / total, 6))
    return got.select(*[F.when(F.col(f"__{b}") == 1, F.lit("*")).otherwise(F.coalesce(F.col(b).cast("string"), F.lit(""))).alias(b) for b in by], "n", "share", "examples")


def _all(by: list[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out = out & (F.col(f"__{b}") == 1)
    return out

