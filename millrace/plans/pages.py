"""Queries over whole pages: composed blocks, block locks, audits of extraction. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.functions import text as X
from millrace.operators import audit as A
from millrace.operators import blocks as K
from millrace.operators import extract as R
from millrace.operators import structure as B
from millrace.plans.catalogue import query, read
from millrace.session import written
from millrace.sources import readers

#: What stands before the lines of a document, by (doc_id + line) mod 12: headings, items, quotes, a table, a fence; plain lines stay as they are.
FORMS = {0: "## ", 1: "- ", 2: "> ", 3: "### ", 5: "| a || ", 6: "|---|:--|", 7: "    1. ", 8: "  * ", 11: "#### "}


def documents_as_pages(spark, d) -> DataFrame:
    """(page, text): the documents as Markdown. Every line keeps its text; lines of form 4 are blank, of form 6 a table's rule, of form 10 a fence in every 4th page."""

    def shaped(line, i):
        k = (F.col("doc_id") + i) % 12
        out = F.when(k == 4, F.lit("")).when(k == 6, F.lit(FORMS[6])).when((k == 10) & (F.col("doc_id") % 4 == 0), F.lit("```"))
        for form, before in FORMS.items():
            if form != 6:
                out = out.when(k == form, F.concat(F.lit(before), line, F.lit(" | z |") if form == 5 else F.lit("")))
        return out.otherwise(line)

    return read(spark, d, "documents").select(F.col("doc_id").alias("page"), F.array_join(F.transform(F.split("text", "\n"), shaped), "\n").alias("text"))


#: DuckDB's \s and \d are ASCII's.
S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"
_FORM = " ".join(f"WHEN {k} THEN '{v}' || t" + (" || ' | z |'" if k == 5 else "") for k, v in FORMS.items() if k != 6)
_LEVELS = range(1, 7)
_LAST = ", ".join(f"max(CASE WHEN level = {k} THEN line END) OVER o AS l{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER o AS t{k}" for k in _LEVELS)
_STANDS = lambda k: " AND ".join([f"l{k} IS NOT NULL", f"own >= {k}", *[f"coalesce(l{j}, -1) < l{k}" for j in range(1, k)]])
_PATH = ", ".join(f"CASE WHEN {_STANDS(k)} THEN t{k} END" for k in _LEVELS)
BLOCKS_SQL = rf"""
WITH l AS (
    SELECT doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents
), m AS (
    SELECT page, line, CASE WHEN (page + line) % 12 = 4 THEN '' WHEN (page + line) % 12 = 6 THEN '{FORMS[6]}' WHEN (page + line) % 12 = 10 AND page % 4 = 0 THEN '```'
        ELSE CASE (page + line) % 12 {_FORM} ELSE t END END AS t FROM l
), f AS (
    SELECT *, regexp_matches(t, '^{S}*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(t, '^{S}*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) % 2 = 1 AS fenced FROM m
), k AS (
    SELECT page, line, t, CASE WHEN NOT fence AND NOT fenced AND regexp_matches(t, '^#{{1,6}}{S}') THEN 'heading' WHEN regexp_matches(t, '^{S}*$') THEN 'blank'
        WHEN regexp_matches(t, '^{S}*\|[\s:|-]+\|{S}*$') THEN 'rule' WHEN regexp_matches(t, '^{S}*\|') THEN 'table' WHEN regexp_matches(t, '^{S}*>') THEN 'quote'
        WHEN regexp_matches(t, '^{S}*([-*+]|[0-9]+[.)]){S}') THEN 'li' ELSE 'para' END AS kind FROM f
), h AS (
    SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(t, '^#+')) END AS level,
        CASE WHEN kind = 'heading' THEN regexp_extract(t, '^#{{1,6}}{S}+(.*?){S}*#*{S}*$', 1) END AS title,
        sum(CASE WHEN kind IN ('para', 'quote') THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS closers,
        sum(CASE WHEN kind IN ('blank', 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS tables FROM k
), a AS (
    SELECT *, coalesce(last_value(level IGNORE NULLS) OVER o, 0) AS own, sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY page, tables ORDER BY line) - 1 AS table_row, {_LAST}
    FROM h WINDOW o AS (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING)
), p AS (
    SELECT *, concat_ws(' > ', {_PATH}) AS path FROM a
), cells AS (
    SELECT *, regexp_split_to_array(regexp_replace(regexp_replace({_TRIM('t')}, '^\|+', ''), '\|+$', ''), '\|') AS c FROM p WHERE kind = 'table'
), b AS (
    SELECT page, line, 0 AS c, closers, 0 AS phase, kind, title AS raw, own, path, 0 AS depth, false AS ordered, NULL AS "row", NULL AS col FROM p WHERE kind = 'heading'
    UNION ALL SELECT page, line, 0, closers, 1, kind, {_TRIM('t')}, own, path, 0, false, NULL, NULL FROM p WHERE kind = 'para'
    UNION ALL SELECT page, line, 0, closers, 0, kind, {_TRIM(f"regexp_replace(t, '^{S}*([-*+]|[0-9]+[.)]){S}+', '')")}, own, path, length(regexp_extract(t, '^{S}*')) // 2, regexp_matches(t, '^{S}*[0-9]+[.)]'), NULL, NULL FROM p WHERE kind = 'li'
    UNION ALL SELECT page, min(line), 0, closers, 2, 'quote', string_agg({_TRIM(f"regexp_replace(t, '^{S}*>{S}?', '')")}, ' ' ORDER BY line), any_value(own), any_value(path), 0, false, NULL, NULL FROM p WHERE kind = 'quote' GROUP BY page, closers
    UNION ALL SELECT page, line, i, closers, 0, 'cell', {_TRIM('c[i + 1]')}, own, path, 0, false, table_row, i FROM (SELECT *, unnest(range(len(c))) AS i FROM cells)
), shown AS (
    SELECT page, (row_number() OVER (PARTITION BY page ORDER BY closers, phase, line, c) - 1)::INTEGER AS ord, kind, own::INTEGER AS level, path, sha256(raw) AS raw_sha256, length(raw)::INTEGER AS chars, line::INTEGER AS line,
        depth::INTEGER AS depth, ordered, "row"::INTEGER AS "row", col::INTEGER AS col FROM b WHERE regexp_matches(raw, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')
)"""


@query(BLOCKS_SQL + " SELECT * FROM shown")
def parsed_blocks(spark, d):
    """Every block of the documents read as Markdown pages, in order: nested lists, tables, quotes, fences and heading paths."""
    b = K.parse(documents_as_pages(spark, d))
    return b.select("page", "ord", "kind", "level", F.array_join("path", " > ").alias("path"), F.sha2("raw", 256).alias("raw_sha256"), F.length("raw").alias("chars"), "line", "depth", "ordered", "row", "col")


@query(BLOCKS_SQL + """ SELECT kind, ordered, depth, count(*)::BIGINT AS n, sum(chars)::BIGINT AS chars, sum(coalesce("row", 0))::BIGINT AS rows, sum(coalesce(col, 0))::BIGINT AS cols FROM shown GROUP BY kind, ordered, depth""")
def body_block_census(spark, d):
    """Blocks by kind, order and depth of list, with the sums of their table places."""
    b = K.parse(documents_as_pages(spark, d)).groupBy("kind", "ordered", "depth")
    return b.agg(F.count("*").alias("n"), F.sum(F.length("raw")).cast("long").alias("chars"), F.sum(F.coalesce("row", F.lit(0))).cast("long").alias("rows"), F.sum(F.coalesce("col", F.lit(0))).cast("long").alias("cols"))


@query()
def block_locks(spark, d):
    """Pages whose stored block lock no longer holds: the documents, and the documents with every 7th cut after its first line."""
    pages = documents_as_pages(spark, d)
    cut = F.when(F.col("page") % 7 == 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text"))
    old, new = K.lock(K.parse(pages)), K.lock(K.parse(pages.withColumn("text", cut)))
    return K.lock_changes(old, new)


_BODY = """
WITH a AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages
), u AS (
    SELECT page_id, url, string_split(body, '<p>')[1] AS head, string_split(body, '<p>')[2:] AS parts FROM a
), t AS (
    SELECT page_id, url, UNESCAPE(regexp_extract(head, '<h1>(.*)</h1>', 1)) AS title,
        list_transform(parts, lambda p: CASE WHEN p LIKE '<b>%' THEN '**' || trim(UNESCAPE(string_split(p[4:], '<br>')[1])) || '**' ELSE trim(UNESCAPE(string_split(p, '</p>')[1])) END) AS paras FROM u
)"""
_UNESCAPE = "regexp_replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\x{{a0}}]+', ' ', 'g')"
PAGES_SQL = _BODY.replace("UNESCAPE(regexp_extract(head, '<h1>(.*)</h1>', 1))", _UNESCAPE.format("regexp_extract(head, '<h1>(.*)</h1>', 1)"))
PAGES_SQL = PAGES_SQL.replace("UNESCAPE(string_split(p[4:], '<br>')[1])", _UNESCAPE.format("string_split(p[4:], '<br>')[1]")).replace("UNESCAPE(string_split(p, '</p>')[1])", _UNESCAPE.format("string_split(p, '</p>')[1]"))


def pages_as_markdown(spark, d) -> DataFrame:
    """(page_id, url, html, md, error) of the web pages."""
    return read(spark, d, "pages").select("page_id", "url", "html", H.markdown_or_error("html", "url").alias("m")).select("page_id", "url", "html", "m.*")


@query(PAGES_SQL + """ SELECT page_id, 1::BIGINT AS headings, length(md)::BIGINT AS n, sha256(md) AS sha256, NULL::VARCHAR AS error
FROM (SELECT page_id, '# ' || trim(title) || chr(10) || chr(10) || array_to_string(list_filter(paras, lambda p: p NOT IN ('', '****')), chr(10) || chr(10)) || chr(10) AS md FROM t)""")
def html_to_markdown(spark, d):
    """Markdown of every page's content: its digest, size and number of headings."""
    headings = F.regexp_count("md", F.lit(r"(?m)^#{1,6} ")).cast("long")
    return pages_as_markdown(spark, d).select("page_id", headings.alias("headings"), F.length("md").cast("long").alias("n"), F.sha2("md", 256).alias("sha256"), "error")


@query(PAGES_SQL + """ SELECT page_id, 1::BIGINT AS sections, 0::BIGINT AS cards, 1::BIGINT AS headings, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS levels FROM t""")
def extraction_audit(spark, d):
    """Headings of the source against those of the Markdown, page by page."""
    return A.extraction(pages_as_markdown(spark, d), "page_id")




_STATEMENT = lambda x: _TRIM(f"regexp_replace(translate({x}, '’‘“”‑‐', '''''\"\"--'), '{S}+', ' ', 'g')")
READERS_SQL = BLOCKS_SQL + rf""", one AS (
    SELECT page, line, level, {_STATEMENT('title')} AS title FROM p WHERE kind = 'heading' AND title <> ''
), two AS (
    SELECT page, line, length(regexp_extract(t, '^#+')) AS level, {_STATEMENT(f"regexp_extract(t, '^#{{1,6}}{S}+(.*?){S}*$', 1)")} AS title FROM m WHERE regexp_matches(t, '^#{{1,6}}{S}')
), met AS (
    SELECT coalesce(a.page, b.page) AS page, a.level AS la, b.level AS lb
    FROM (SELECT *, row_number() OVER (PARTITION BY page, title ORDER BY line) AS k FROM one) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY page, title ORDER BY line) AS k FROM two) b
    ON a.page = b.page AND a.title = b.title AND a.k = b.k
)
SELECT page, count(la)::BIGINT AS parsed, count(lb)::BIGINT AS scanned, count_if(lb IS NULL)::BIGINT AS missing, count_if(la IS NULL)::BIGINT AS extra, (count(*) FILTER (WHERE la <> lb))::BIGINT AS levels FROM met GROUP BY page"""


@query(READERS_SQL)
def heading_readers(spark, d):
    """Headings as the block parser reads them against a plain scan of the lines: fences, closing marks and levels show."""
    pages = documents_as_pages(spark, d)
    parsed = K.parse(pages).where("kind = 'heading'").select("page", "ord", "level", F.col("raw").alias("title"))
    got = A.compared(parsed, A.markdown_headings(pages, "page", "text")).groupBy("page")
    return got.agg(F.count("source_level").alias("parsed"), F.count("md_level").alias("scanned"), *[F.count_if(F.col("state") == s).alias(n) for s, n in (("missing", "missing"), ("extra", "extra"), ("level", "levels"))])


#: Words that open an instruction in the documents' four languages, as a site's own lexicon.
OPENERS = ("the", "that", "is", "que", "les", "der", "und", "los", "de")
_CLASS = "regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(must|should|shall|needs? to|ought to|may|can|cannot|can''t|is required to)($|[^\\p{L}\\p{N}_])')"
_NEGATIVE = "regexp_matches(lower(s), '^(don''t |dont |do not |never |avoid )')"
CANDIDATES_SQL = BLOCKS_SQL.replace("), shown AS (", "), shown_unused AS (") + rf""", heads AS (
    SELECT page, line, own AS level, title, path, lead(line) OVER (PARTITION BY page ORDER BY line) AS until FROM p WHERE kind = 'heading'
), told AS (
    SELECT *, {_TRIM(f"regexp_replace(translate(title, '’‘“”‑‐', '''''\"\"--'), '{S}+', ' ', 'g')")} AS s FROM heads
), kinds AS (
    SELECT *, regexp_extract_all(s, '[A-Za-z][A-Za-z''’\-]*') AS w FROM told
), forms AS (
    SELECT *, CASE WHEN lower(s) IN ('write this','do this','correct','like this','not this','don''t do this','incorrect','example','examples','more information') OR s = ''
            OR lower(s) IN ('last updated','about this page','references','release notes','style manual pages','evidence','contents','on this page','in this section') THEN NULL
        WHEN regexp_matches(s, '(?i)^(?:PO Box|GPO Box|Locked Bag|Level [0-9]|Phone|Email|Fax|ABN|ACN)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(s, '^[A-Z][A-Za-z''’\-]+(?:\s+[A-Z][A-Za-z''’\-]+){{1,3}}(?:\s+[A-Z]{{2,4}})?\s*(?:,[^(]{{0,60}})?\([^)]+\)\s*$') THEN NULL
        WHEN len(w) < 2 THEN NULL WHEN {_NEGATIVE} THEN 'negative_imperative' WHEN lower(w[1]) IN ({", ".join(f"'{v}'" for v in OPENERS)}) THEN 'imperative' WHEN {_CLASS} THEN 'modal' END AS form FROM kinds
), bodies AS (
    SELECT f.page, f.line, string_agg(m.t, chr(10) ORDER BY m.line) AS body FROM forms f JOIN m ON m.page = f.page AND m.line > f.line AND m.line < coalesce(f.until, 1000000000) WHERE form IS NOT NULL AND level > 1 GROUP BY ALL
)
SELECT f.page, f.line::INTEGER AS line, f.level::INTEGER AS level, path, s AS statement, form, sha256({_TRIM("coalesce(body, '')")}) AS body_sha256, sha256(f.page || chr(31) || path || chr(31) || s) AS uid
FROM forms f LEFT JOIN bodies b ON b.page = f.page AND b.line = f.line WHERE form IS NOT NULL AND level > 1"""


def _sha_uid(page, path, statement):
    """What DuckDB can say of an id: SHA-256 over the same three parts."""
    return F.sha2(F.concat_ws("\x1f", page, F.array_join(path, " > "), statement), 256)


@query(CANDIDATES_SQL)
def page_candidates(spark, d):
    """The rule candidates of the documents read as pages: parsed headings, classified, with path, body and id."""
    got = R.heading_candidates(K.nodes(documents_as_pages(spark, d)), OPENERS, uid=_sha_uid)
    return got.select("page", "line", "level", F.array_join("path", " > ").alias("path"), "statement", "form", F.sha2("body", 256).alias("body_sha256"), "uid")


@query()
def ledger_run(spark, d):
    """From pages to the next ledger: the pages before without their digits, the first ledger, decisions, marked spans, and the run over the pages as they are."""
    raw = documents_as_pages(spark, d).withColumn("page", F.col("page").cast("string"))
    before = raw.withColumn("text", F.translate("text", "0123456789", ""))
    pages = lambda p: B.normalised_pages(p.select(F.col("page").alias("path"), F.col("text").alias("raw"))).select(F.col("path").alias("page"), "text", "sha256")
    urls = raw.select("page", F.concat(F.lit("https://docs.example/"), "page").alias("url"))
    old = written(pages(before))  # read three times; composing the texts costs more than their table
    rules = R.as_rules(R.heading_candidates(K.nodes(old), OPENERS).withColumn("origin", F.lit("heading")), urls, old.select("page", "sha256"), "t0")
    rules = written(rules.dropDuplicates(["uid"]).withColumn("status", F.when(F.col("modality") == "MUST", "accepted").when(F.length("body") == 0, "rejected").otherwise("proposed")))
    now = written(pages(raw))
    calls = K.parse(now).where("kind IN ('para', 'heading') AND level > 1").withColumn("quote", F.regexp_extract("plain", r"^[^.!?]*!", 0)).where("quote <> ''")
    none = F.lit(None).cast("string")
    spans = written(calls.select(F.col("block_id").alias("span_id"), "page", "block_id", F.lit(0).alias("start"), F.length("quote").alias("end"), F.lit("rule").alias("kind"), none.alias("of"), none.alias("grp"), "quote", none.alias("seed_uid")))
    swept = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("page")).distinct()
    got, _ = R.next_ledger(now, spans, swept, rules, urls, "t1", OPENERS)
    return got.select("uid", "page", "status", "method", "form", "modality", "line", F.size("history").alias("moves"), F.size("uid_history").alias("moved"), F.sha2(F.concat_ws("\x1f", "statement", "body", "url", "sha256", "note"), 256).alias("text_sha256"))


_BRANCH = rf"""CASE WHEN lower(s) IN ('write this','do this','correct','like this','not this','don''t do this','incorrect','example','examples','more information') THEN 'label'
        WHEN s = '' OR lower(s) IN ('last updated','about this page','references','release notes','style manual pages','evidence','contents','on this page','in this section') THEN 'boilerplate'
        WHEN regexp_matches(s, '(?i)^(?:PO Box|GPO Box|Locked Bag|Level [0-9]|Phone|Email|Fax|ABN|ACN)($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(s, '^[A-Z][A-Za-z''’\-]+(?:\s+[A-Z][A-Za-z''’\-]+){{1,3}}(?:\s+[A-Z]{{2,4}})?\s*(?:,[^(]{{0,60}})?\([^)]+\)\s*$') THEN 'contact'
        WHEN len(w) < 2 THEN 'one word' WHEN {_NEGATIVE} THEN 'opener' WHEN lower(w[1]) IN ({", ".join(f"'{v}'" for v in OPENERS)}) THEN 'verb' WHEN {_CLASS} THEN 'modal' ELSE 'none' END"""
AUDIT_SQL = CANDIDATES_SQL[: CANDIDATES_SQL.index(", forms AS (")] + f""", read AS (
    SELECT {_BRANCH} AS branch, level::VARCHAR AS level, s AS title FROM kinds
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY branch, level ORDER BY title) AS k FROM (SELECT branch, level, title, count(*) AS n FROM read GROUP BY ALL)
)
SELECT coalesce(branch, '*') AS branch, coalesce(level, '*') AS level, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM ranked), 6) AS share,
    sha256(array_to_string(list_sort(list(DISTINCT title) FILTER (WHERE k <= 40))[1:40], chr(31))) AS examples_sha256
FROM ranked GROUP BY CUBE (branch, level)"""


@query(AUDIT_SQL)
def heading_audit(spark, d):
    """How the headings of the documents are read: a census by deciding test and level, with margins, shares and the first forty titles of each."""
    found = written(B.ancestry(B.headings(B.lines(documents_as_pages(spark, d)))))
    read_as = found.withColumn("s", X.composed_statement(F.col("title"))).withColumn("k", X.heading_kind(F.col("s"), OPENERS))
    rows = read_as.select(F.col("k.branch").alias("branch"), F.col("level").cast("string").alias("level"), F.col("s").alias("title"))
    got = A.census(rows, ["branch", "level"])
    return got.select("branch", "level", "n", "share", F.sha2(F.array_join("examples", "\x1f"), 256).alias("examples_sha256"))


@query("""
WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS part FROM pages)
SELECT p.url AS loc, 'http://' || p.host || '/' || p.part || '/sitemap.xml' AS sitemap, 2::INTEGER AS depth, CASE WHEN length(p.url) % 3 = 0 THEN '2024-01-0' || (length(p.host) % 9 + 1) END AS lastmod FROM p
""")
def sitemap_crawl(spark, d):
    """The addresses of the pages, found from one index through the sitemap of each host to that of each of its parts; every other one is an HTML table, and all lead back to the index."""
    host, part = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    p = read(spark, d, "pages").select("url").distinct().select("url", host.alias("host"), part.alias("part"))
    escaped = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    at = F.concat(F.lit("http://"), "host", F.lit("/"), "part", F.lit("/sitemap.xml"))
    day = F.when(F.length("url") % 3 == 0, F.concat(F.lit("2024-01-0"), F.length("host") % 9 + 1)).otherwise("")
    as_xml = F.concat(F.lit("<url><loc>"), escaped("url"), F.lit("</loc>"), F.when(day != "", F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    as_row = F.concat(F.lit('<tr><td><a href="'), escaped("url"), F.lit('">x</a></td><td>'), day, F.lit("</td></tr>"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    leaves = p.groupBy(at.alias("url"), "host").agg(listed(as_xml).alias("xml"), listed(as_row).alias("rows"))
    table = F.concat(F.lit('<table class="sitemap">'), "rows", F.lit('</table><a href="http://index/sitemap.xml">back</a>'))
    leaves = leaves.select("url", "host", F.when(F.length("host") % 2 == 0, F.concat(F.lit("<urlset>"), "xml", F.lit("</urlset>"))).otherwise(table).alias("body"))
    index = lambda c: F.concat(F.lit("<?xml version='1.0'?><sitemapindex>"), listed(F.concat(F.lit("<sitemap><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc></sitemap>"))), F.lit("<sitemap><loc>http://index/sitemap.xml</loc></sitemap></sitemapindex>"))
    of_host = F.concat(F.lit("http://"), "host", F.lit("/sitemap.xml"))
    hosts = leaves.groupBy(of_host.alias("url")).agg(index(F.col("url")).alias("body"))
    top = hosts.agg(index(F.col("url")).alias("body")).select(F.lit("http://index/sitemap.xml").alias("url"), "body")
    bodies = leaves.select("url", "body").unionByName(hosts).unionByName(top)
    return readers.crawled_sitemaps(bodies, "http://index/sitemap.xml").select("loc", "sitemap", "depth", "lastmod")
