"""Pages to rows: heading trees, body blocks, documents with offsets, example blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.udfs import repair_headings

LEVELS = range(1, 7)


def lines(pages: DataFrame, key: str = "page", text: str = "text") -> DataFrame:
    """(key, line, txt)."""
    return pages.select(key, F.posexplode(F.split(text, "\n")).alias("line", "txt"))


def headings(page_lines: DataFrame, key: str = "page") -> DataFrame:
    """(key, line, level, title) of ATX headings outside fences."""
    before = Window.partitionBy(key).orderBy("line")
    fence = F.col("txt").rlike(r"^\s*(```|~~~)")
    rows = page_lines.withColumn("fenced", F.sum(fence.cast("int")).over(before) % 2 == 1)
    pattern = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    rows = rows.where(~F.col("fenced") & ~fence & F.col("txt").rlike(pattern))
    return rows.select(key, "line", F.length(F.regexp_extract("txt", pattern, 1)).alias("level"), F.regexp_extract("txt", pattern, 2).alias("title"))


def ancestry(rows: DataFrame, key: str = "page", order: str = "line", level: str = "level", title: str = "title", trail: str | None = None) -> DataFrame:
    """Adds ``path``: titles from the top to the row itself, and as ``trail`` their places, where a name for it is given.

    One window by page; an ancestor at level k stands iff no smaller level came after it.
    """
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in LEVELS:
        rows = rows.withColumn(f"__l{k}", F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(title).alias("t"))), ignorenulls=True).over(upto))
    parts, places = [], []
    for k in LEVELS:
        own = F.col(f"__l{k}")
        stands = own.isNotNull() & (F.col(level) >= k)
        for j in range(1, k):
            stands = stands & (F.col(f"__l{j}").isNull() | (F.col(f"__l{j}.at") < own["at"]))
        parts.append(F.when(stands, own["t"]))
        places.append(F.when(stands, own["at"]))
    if trail:
        rows = rows.withColumn(trail, F.array_compact(F.array(*places)))
    return rows.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"__l{k}" for k in LEVELS])


def bodies(page_lines: DataFrame, found: DataFrame, key: str = "page") -> DataFrame:
    """(key, line, body): the lines below each heading up to the next one; line -1 is what comes before any."""
    marked = page_lines.join(found.select(key, "line", F.lit(True).alias("head")), [key, "line"], "left")
    upto = Window.partitionBy(key).orderBy("line")
    marked = marked.withColumn("own", F.coalesce(F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(upto), F.lit(-1)))
    kept = marked.where(F.col("head").isNull()).groupBy(key, F.col("own").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("at"), "txt"))).alias("b"))
    return kept.select(key, "line", F.regexp_replace(F.array_join(F.transform("b", lambda x: x["txt"]), "\n"), r"^\n+|\n+$", "").alias("body"))


def occurrences(blocks: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Adds ``occurrence``: how many equal blocks of the same keys came before."""
    return blocks.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, block, start, end, text): chunks between separators; blank chunks are left out but count for offsets and numbers."""
    parts = docs.select(key, F.posexplode(F.split(text, separator.replace("\n", r"\n"))).alias("block", "text"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(separator)).over(before), F.lit(0))
    parts = parts.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
    return parts.where(X.strip(F.col("text")) != "").select(key, "block", "start", "end", "text")


def text_blocks_narrow(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """text_blocks() without a shuffle: the offsets are folded inside each row, then exploded."""
    parts = F.split(text, separator.replace("\n", r"\n"))
    sep = len(separator)

    def add(state: Column, part: Column) -> Column:
        own = F.struct(state["next"].alias("start"), part.alias("text"))
        return F.struct(F.concat(state["out"], F.array(own)).alias("out"), (state["next"] + F.length(part) + sep).alias("next"))

    zero = F.struct(F.array().cast("array<struct<start:int,text:string>>").alias("out"), F.lit(0).alias("next"))
    rows = docs.select(key, F.posexplode(F.aggregate(parts, zero, add, lambda s: s["out"])).alias("block", "p"))
    rows = rows.select(key, "block", "p.start", (F.col("p.start") + F.length("p.text")).alias("end"), "p.text")
    return rows.where(X.strip(F.col("text")) != "")


def joined_offsets(blocks: DataFrame, key: str = "page", order: str = "ord", plain: str = "plain", span: int = 4096) -> DataFrame:
    """Adds start and end of each block in the text that joins a page's blocks with empty lines.

    Lengths are summed by ranges of ``span`` orders first; a range's rows are then offset by the ranges before it, so a
    page of any size is dealt over many tasks. Orders are numbers.
    """
    rows = blocks.withColumn("__cell", F.floor(F.col(order) / span))
    cells = rows.groupBy(key, "__cell").agg(F.sum(F.length(plain) + 2).alias("__n"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(key, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(cells, [key, "__cell"]).withColumn("start", F.col("__from") + F.coalesce(F.sum(F.length(plain) + 2).over(inside), F.lit(0)))
    return rows.drop("__cell", "__from").withColumn("end", F.col("start") + F.length(plain))


def example_blocks(blocks: DataFrame, key: str = "page", order: str = "ord", labels: tuple[str, ...] = X.POSITIVE_LABELS + X.NEGATIVE_LABELS + X.NEUTRAL_LABELS) -> DataFrame:
    """Adds ``example``: list items right below a label, or failing those its first paragraph or quote; anything else closes it."""
    label = F.regexp_replace(F.lower(X.strip(F.col("plain"))), ":+$", "")
    opens = (F.col("kind") == "heading") | ((F.col("kind") == "para") & label.isin(*labels))
    in_order = Window.partitionBy(key).orderBy(order)
    rows = blocks.withColumn("__opens", opens).withColumn("__is", opens & label.isin(*labels)).withColumn("__run", F.sum(opens.cast("int")).over(in_order))
    run = Window.partitionBy(key, "__run").orderBy(order)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__open", F.first("__is").over(run)).withColumn("__path", F.first("path").over(run))
    same = F.col("path").eqNullSafe(F.col("__path"))
    item, prose = (F.col("kind") == "li"), F.col("kind").isin("para", "quote")
    others = F.coalesce(F.sum((~F.col("__opens") & same).cast("int")).over(before), F.lit(0))
    not_items = F.coalesce(F.sum((~F.col("__opens") & same & ~item).cast("int")).over(before), F.lit(0))
    own = ~F.col("__opens") & F.col("__open") & same
    return rows.withColumn("example", F.coalesce(own & ((item & (not_items == 0)) | (prose & (others == 0))), F.lit(False))).drop("__opens", "__is", "__run", "__open", "__path")


def polarised(found: DataFrame, key: str = "page") -> DataFrame:
    """(key, parent): headings whose direct children label both kinds of examples. ``found`` has path."""
    t = F.lower(X.normalise_statement(F.col("title")))
    child = found.where(F.size("path") > 1).withColumn("parent", F.slice("path", 1, F.size("path") - 1))
    return child.groupBy(key, "parent").agg(F.bool_or(t.isin(*X.COMPLIANT)).alias("c"), F.bool_or(t.isin(*X.VIOLATING)).alias("v")).where("c AND v").select(key, "parent")


def digest_rows(rows: DataFrame, key: str, order: str, *parts: str) -> DataFrame:
    """(key, digest, n): sha256 over a key's rows in order, fields and rows framed."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s")))).alias("r"), F.count("*").alias("n"))
    return got.select(key, F.sha2(F.array_join(F.transform("r", lambda x: x["s"]), "\x1e"), 256).alias("digest"), "n")


def without_negative(page_blocks: DataFrame, key: str = "page") -> DataFrame:
    """Rows that do not stand below a heading that labels wrong examples; the heading path says so without a running state."""
    bad = F.exists("path", lambda t: F.lower(X.normalise_statement(t)).isin(*X.NEGATIVE_LABELS))
    return page_blocks.where(~bad)


def rendered(blocks: DataFrame, seeds: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, text): a page as plain lines ``[id] KIND  text`` below its path and title.

    blocks: page, ord, block_id, kind, level, depth, ordered, cell (array of row and column), plain; seeds: page, block_id; titles: page, title.
    """
    labels = X.POSITIVE_LABELS + X.NEGATIVE_LABELS + X.NEUTRAL_LABELS
    rows = blocks.join(seeds.select("page", "block_id").distinct().withColumn("__seed", F.lit(True)), ["page", "block_id"], "left")
    mark = F.when(F.col("__seed"), " ⟨candidate⟩").when(F.lower(X.strip(F.col("plain"))).isin(*labels), " ⟨label⟩").otherwise("")
    tag = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("H"), F.col("level").cast("string"), mark))
        .when(F.col("kind") == "li", F.concat(F.lit("LI"), F.repeat(F.lit("."), F.coalesce("depth", F.lit(0))), F.when(F.col("ordered"), " ordered").otherwise("")))
        .when(F.col("kind") == "cell", F.concat(F.lit("CELL"), F.coalesce(F.concat(F.lit(" "), F.array_join(F.col("cell").cast("array<string>"), ",")), F.lit(""))))
        .when(F.col("kind") == "para", "P").otherwise(F.upper("kind"))
    )
    line = F.concat(F.lit("["), F.col("block_id"), F.lit("] "), tag, F.lit("  "), F.col("plain"))
    lines = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("PAGE: "), F.col("page").cast("string"), F.lit("\nTITLE: "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    return lines.join(titles, "page", "left").select("page", F.concat(head, "body").alias("text"))


def normalised_pages(pages: DataFrame) -> DataFrame:
    """Adds text, promotions and sha256 to pages (path, raw): normalised, lost headings put back, and normalised again."""
    return pages.withColumn("__r", repair_headings(X.composed_text(F.col("raw")))).select(
        *pages.columns, X.composed_text(F.col("__r.text")).alias("text"), F.col("__r.promotions").alias("promotions")
    ).withColumn("sha256", F.sha2("text", 256))
