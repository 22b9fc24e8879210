"""Readers: corpora, ledgers, operation logs, proposals, drafts, sitemaps, settings. All but the last two read with Spark alone."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.html import sitemap_table
from millrace.session import dropped, written

PAIR = "array<string>"
RULE = f"""uid string, statement string, modality string, direction string, unit string, clarity string, specification string, violation_condition string,
 compliant_examples {PAIR}, violating_examples {PAIR}, source struct<page_path:string,heading_path:{PAIR},statement:string,body_excerpt:string,line_start:int>,
 detection struct<detectable:boolean,tier:int,method:string,not_detectable_reason:string,matcher:string>, review struct<status:string,history:array<struct<at:string,by:string,to:string,note:string>>>, supersedes string"""
OP = "op string, op_id string, by string, at string, uid string, page_path string, patch string, span string, key string, status string"
SPAN = f"span_id string, kind string, page_path string, page_sha256 string, anchor struct<block_id:string,start:int,end:int,quote:string,prefix:string,suffix:string>, of string, `group` string, tags string, preconditions {PAIR}, seed_uid string, seed_draft string, `by` string, at string"


class SourceError(ValueError):
    """An input that cannot be taken as it is."""


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(page, text): every .md file below a folder, by path relative to it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(folder.rstrip("/")) + "/", "").alias("page"), F.col("value").alias("text"))


def scan_disk(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(path, sha256, lastmod): a snapshot of the Markdown below a folder, with the last change that an older lock (path, lastmod) has."""
    from millrace.operators.structure import normalised_pages

    pages = normalised_pages(markdown(spark, folder).select(F.col("page").alias("path"), F.col("text").alias("raw"))).select("path", "sha256")
    return pages.withColumn("lastmod", F.lit(None).cast("string")) if known is None else pages.join(known.select("path", "lastmod"), "path", "left")


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """(page, text): every text file of a path as one block-separated page."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("text"))


def ledger(spark: SparkSession, path: str, schema: str = RULE) -> DataFrame:
    """Rules from JSON lines; a malformed line or a repeated uid is refused."""
    rules = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return checked(rules, repeated_uids(rules), "repeated uids")


def checked(rows: DataFrame, refused: DataFrame, what: str) -> DataFrame:
    """``rows``, if nothing of them is refused; else SourceError with up to five of the refusals."""
    if some := refused.limit(5).collect():
        raise SourceError(f"{what}: {[tuple(r) for r in some]}")
    return rows


def repeated_uids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("uid").count().where("count > 1").select("uid")


def spans(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("rule", "example", "precondition")) -> tuple[DataFrame, DataFrame]:
    """Golden spans, and those refused with a reason."""
    rows = spark.read.schema(SPAN).json(path)
    why = F.when(F.col("page_path").isNull(), "no page_path").when(~F.col("kind").isin(*kinds), "unknown kind")
    rows = rows.withColumn("reason", why)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def last_sweep(markers: DataFrame) -> DataFrame:
    """The last marker of each page, by time, then note."""
    own = Window.partitionBy("page_path").orderBy(F.col("at").desc(), F.col("note").desc())
    return markers.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def operations(spark: SparkSession, *paths: str) -> DataFrame:
    """Operation logs with the file each came from; order them by (at, op_id), as texts. A row without an op is refused."""
    rows = spark.read.schema(OP).json(list(paths)).withColumn("file", F.col("_metadata.file_name"))
    return checked(rows, rows.where("op IS NULL").select("file", "op_id"), "operations without op")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(origin, value): lines with file:line, numbered inside whole files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return files.where(F.trim("value") != "").select(F.concat_ws(":", "f", F.col("n") + 1).alias("origin"), "value")


def keyed_map(spark: SparkSession, path: str, member: str, value: str = "string") -> DataFrame:
    """(key, value) of one object member of a JSON document; a missing document or member gives no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"key string, value {value}")
    text = spark.read.text(path, wholetext=True)
    kind = T.MapType(T.StringType(), T.StringType()) if value == "string" else f"map<string,{value}>"
    return text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{member}"), kind)).alias("key", "value"))


def latest(drafts: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    rest = [c for c in drafts.columns if c != key]
    return drafts.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("m")).select(key, "m.*")


def valid_verdicts(verdicts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Cached verdicts whose input is still the same."""
    return verdicts.join(inputs, ["page_path", "input_sha256"], "left_semi")


def cache_state(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds state: new, cached or stale."""
    held = cache.select("page_path", F.col("input_sha256").alias("held"))
    return pages.join(held, "page_path", "left").withColumn("state", F.when(F.col("held").isNull(), "new").when(F.col("held") == F.col("input_sha256"), "cached").otherwise("stale")).drop("held")


def word_list(lines: list[str]) -> tuple[str, ...]:
    """A lexicon: comments and empty lines dropped, lower case, in order."""
    return tuple(dict.fromkeys(x.strip().lower() for x in lines if x.strip() and not x.startswith("#")))


def globs(text: str) -> list[tuple[str, bool, bool]]:
    """(glob, eligible, needs review) from the settings' two lists."""
    out: list[tuple[str, bool, bool]] = []
    eligible = True
    for line in text.splitlines():
        if re.match(r"^(eligible|excluded):", line):
            eligible = line.startswith("eligible")
        elif m := re.match(r'^\s+- glob:\s*"([^"]+)"', line):
            out.append((m.group(1), eligible, False))
        elif re.match(r"^\s+requires_unit_review:\s*true", line) and out:
            out[-1] = (*out[-1][:2], True)
    return out


def settings(text: str) -> dict[str, str]:
    """Scalars and folded blocks of a flat settings file."""
    out: dict[str, str] = {}
    key = None
    for line in text.splitlines():
        if m := re.match(r"^(\w+):\s*(.*?)\s*$", line):
            key = m.group(1)
            out[key] = "" if m.group(2) in (">", "|", ">-") else m.group(2).strip("\"'")
        elif key and line.startswith(" ") and line.strip():
            out[key] = f"{out[key]} {line.strip()}".strip()
    return out


SITEMAP = T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType()), T.StructField("index", T.BooleanType())]))


def sitemap_rows(body: str | None, url: str = "") -> list[tuple[str, str | None, bool]]:
    """(loc, lastmod, nested) of a sitemap, a sitemap index, or the HTML table that a style sheet makes of either; broken XML has none."""
    body = (body or "").lstrip()
    if not body[:200].lower().startswith(("<?xml", "<urlset", "<sitemapindex")):
        return sitemap_table(body, url)
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    if name(root) not in ("urlset", "sitemapindex"):
        return []
    out = []
    for entry in root:
        fields = {name(c): (c.text or "").strip() for c in entry}
        if fields.get("loc") and name(entry) == ("sitemap" if name(root) == "sitemapindex" else "url"):
            out.append((fields["loc"], fields.get("lastmod"), name(entry) == "sitemap"))
    return out


@F.udf(SITEMAP, useArrow=True)
def sitemap(body: str, url: str):
    return sitemap_rows(body, url or "")


def crawled_sitemaps(bodies: DataFrame, start: str) -> DataFrame:
    """(sitemap, depth, loc, lastmod): the content addresses of a sitemap and of all that it leads to, each sitemap read once.

    bodies: url, body, what was fetched; addresses that weren't are dead ends. Every body is parsed once, then the frontier
    moves outwards by joins until it finds nothing new, so a ring of sitemaps ends.
    """
    spark = bodies.sparkSession
    entries = written(bodies.groupBy("url").agg(F.max("body").alias("body")).select("url", F.explode(sitemap("body", "url")).alias("e")).select("url", "e.loc", "e.lastmod", F.col("e.index").alias("nested")))
    links = entries.where("nested").select("url", F.col("loc").alias("to")).distinct()
    seen = written(spark.createDataFrame([(start, 0)], "url string, depth int"))
    while True:
        depth = F.col("depth") + 1
        edge = seen.join(links, "url").groupBy(F.col("to").alias("url")).agg(F.min(depth).alias("depth")).join(seen.select("url"), "url", "left_anti")
        grown = written(seen.unionByName(edge))
        done = grown.count() == seen.count()
        dropped(seen)
        seen = grown
        if done:
            return entries.where("NOT nested").join(seen, "url").select(F.col("url").alias("sitemap"), "depth", "loc", "lastmod")
