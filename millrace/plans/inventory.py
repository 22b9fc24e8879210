"""Queries from pages to rules and their review: candidates, golden rules, the rebuilt ledger, recall, patches, pointers.

Importing this module completes the catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import extract as R
from millrace.operators import golden as G
from millrace.operators import ledger as L
from millrace.operators import structure as B
from millrace.plans import pages, placing, reviews, scores  # noqa: F401  they register their queries
from millrace.plans.catalogue import oracle_sql, queries, query, read

__all__ = ["oracle_sql", "queries"]
NONE = "array<string>"


@query("""
SELECT form, count(*)::BIGINT AS n, sum(length(trim(p_name)))::BIGINT AS chars FROM (
    SELECT p_name, CASE WHEN p_partkey % 3 = 0 THEN 'imperative' ELSE 'exemplified' END AS form FROM part
    WHERE p_partkey % 4 <> 0 AND (p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 5 = 0))) GROUP BY form
""")
def candidate_admission(spark, d):
    """Headings that become rule candidates: parts as headings of four levels."""
    k = F.col("p_partkey")
    nodes = read(spark, d, "part").select(
        (1 + k % 4).alias("level"), F.col("p_name").alias("title"), F.when(k % 3 == 0, "rule").when(k % 3 == 1, "section").otherwise("boilerplate").alias("kind"),
        F.when(k % 3 == 0, "imperative").otherwise("").alias("form"), F.when(k % 5 == 0, True).alias("paired"),
    )
    return R.admitted(nodes).groupBy("form").agg(F.count("*").alias("n"), F.sum(F.length("statement")).cast("long").alias("chars"))


@query("""
SELECT page, origin, count(*)::BIGINT AS n, sum(uid)::BIGINT AS uids FROM (
    SELECT o_custkey AS page, o_orderkey AS uid, 'golden' AS origin FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_custkey, o_orderkey, 'heading' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_custkey % 4 <> 0) GROUP BY page, origin
""")
def collected_candidates(spark, d):
    """Read and marked candidates merged, page by page."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("uid"))
    got = R.collected(o.where("uid % 2 = 0"), o.where("uid % 3 = 0"), o.where("page % 4 = 0").select("page"))
    return got.groupBy("page", "origin").agg(F.count("*").alias("n"), F.sum("uid").cast("long").alias("uids"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS o, s_name AS uid, s_nationkey::VARCHAR AS page, CASE WHEN s_suppkey % 7 = 0 THEN 'orphaned' WHEN s_suppkey % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS status, s_nationkey % 2 = 0 AS swept FROM supplier)
SELECT uid, status, history, coalesce(supersedes, '') AS supersedes, uid_history, note, method FROM (
    SELECT uid, CASE WHEN k % 2 = 0 THEN 'proposed' ELSE status END AS status, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS history, NULL AS supersedes, '' AS uid_history, 'old' AS note, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'human_span' ELSE 'heading_structure' END AS method FROM s WHERE o = 0
    UNION ALL SELECT uid, status, 0, NULL, '', 'old', CASE WHEN k % 3 = 0 THEN 'human_span' ELSE 'heading_structure' END FROM s WHERE o = 1
    UNION ALL SELECT uid, status, 0, NULL, '', 'old', 'heading_structure' FROM s WHERE o = 2
    UNION ALL SELECT 'n' || uid, status, 0, NULL, uid, 'old', 'heading_structure' FROM s WHERE o = 3
    UNION ALL SELECT uid, 'superseded', 1, NULL, '', 'old', 'heading_structure' FROM s WHERE o = 4
    UNION ALL SELECT 'n' || uid, 'proposed', 0, uid, '', '', CASE WHEN k % 3 = 0 THEN 'human_span' ELSE 'heading_structure' END FROM s WHERE o = 4
    UNION ALL SELECT uid, CASE WHEN swept AND status = 'rejected' THEN status ELSE 'orphaned' END, CASE WHEN swept AND status = 'rejected' THEN 0 ELSE 1 END, NULL, '', 'old', 'heading_structure' FROM s WHERE o = 5
    UNION ALL SELECT 'n' || uid, 'proposed', 0, NULL, '', 'LINEAGE UNRESOLVED: may supersede ' || uid || '. Human decision required.', CASE WHEN k % 3 = 0 THEN 'human_span' ELSE 'heading_structure' END FROM s WHERE o = 6)
""")
def ledger_rebuild(spark, d):
    """The next ledger, with suppliers as rules and an outcome for each."""
    s = read(spark, d, "supplier")
    k, o, uid = F.col("s_suppkey"), F.col("s_suppkey") % 7, F.col("s_name")
    page = F.col("s_nationkey").cast("string")
    new_uid = F.when(o.isin(3, 4, 6), F.concat(F.lit("n"), uid)).otherwise(uid)
    candidates = s.where((o != 5) & ((o != 0) | (k % 2 == 0))).select(
        new_uid.alias("uid"), page.alias("page"), F.array(page).alias("path"), uid.alias("statement"), F.lit("imperative").alias("form"), F.lit("b").alias("body"),
        k.cast("int").alias("line"), F.when(k % 3 == 0, "golden").otherwise("heading").alias("origin"), F.array().cast(NONE).alias("preconditions"), F.create_map(F.lit("write this"), F.array(F.lit("x"))).alias("examples"),
    )
    urls, hashes = s.select(page.alias("page"), F.concat(F.lit("u/"), page).alias("url")).distinct(), s.select(page.alias("page"), F.lit("h").alias("sha256")).distinct()
    old = R.as_rules(s.select(uid.alias("uid"), page.alias("page"), F.array(page).alias("path"), uid.alias("statement"), F.lit("imperative").alias("form"), F.lit("b").alias("body"), F.lit(1).alias("line"), F.lit("heading").alias("origin"), F.array().cast(NONE).alias("preconditions"), F.create_map(F.lit("write this"), F.array(F.lit("x"))).alias("examples")), urls, hashes, "t0")
    state = s.select(uid.alias("uid"), F.when(o == 0, "orphaned").when(k % 5 == 0, "rejected").otherwise("accepted").alias("state"))
    old = old.join(state, "uid").withColumn("status", F.col("state")).withColumn("note", F.lit("old")).drop("state")
    names = ("added", "unchanged", "body_altered", "rehomed", "reworded", "orphaned", "ambiguous")
    outcome = F.element_at(F.array(*map(F.lit, names)), (o + 1).cast("int"))
    outcomes = s.where((o != 0) | (k % 2 == 0)).select(outcome.alias("outcome"), F.when(o != 0, uid).alias("old_uid"), F.when(o != 5, new_uid).alias("cand_uid"))
    swept = s.where("s_nationkey % 2 = 0").select(page.alias("page"))
    got = R.rebuilt(old, outcomes, candidates, swept, urls, hashes, "t1")
    return got.select("uid", "status", F.size("history").alias("history"), F.coalesce("supersedes", F.lit("")).alias("supersedes"), F.array_join("uid_history", ",").alias("uid_history"), "note", "method")


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS whole, o_orderpriority AS t FROM orders),
e AS (SELECT l_orderkey AS k, l_linenumber % 2 AS bad, l_linenumber // 3 AS grp, l_linenumber AS n, l_linestatus AS q FROM lineitem),
u AS (SELECT k, bad, grp, min(n) AS place, string_agg(q, '+' ORDER BY n, q) AS x FROM e GROUP BY k, bad, grp),
g AS (SELECT k, coalesce(string_agg(x, '|' ORDER BY place) FILTER (WHERE bad = 0), '') AS compliant, coalesce(string_agg(x, '|' ORDER BY place) FILTER (WHERE bad = 1), '') AS violating FROM u GROUP BY k)
SELECT r.k AS span_id, whole, CASE WHEN r.k % 3 = 0 THEN t ELSE substring(t, 1, 3) END AS statement, coalesce(compliant, '') AS compliant, coalesce(violating, '') AS violating FROM r LEFT JOIN g USING (k)
""")
def golden_inventory(spark, d):
    """Marked rules with their examples in page order: orders as rules, line items as examples."""
    o, i = read(spark, d, "orders"), read(spark, d, "lineitem")
    t, k = F.col("o_orderpriority"), F.col("o_orderkey")
    blocks = o.select(F.lit("p").alias("page"), k.cast("string").alias("block_id"), k.alias("ord"), F.when(k % 2 == 0, "heading").otherwise("para").alias("kind"), t.alias("plain"), F.array(t).alias("path"), F.lit(1).alias("line"))
    rules = o.select(k.cast("string").alias("span_id"), F.lit("p").alias("page"), k.cast("string").alias("block_id"), F.lit(0).alias("start"), F.when(k % 3 == 0, F.length(t)).otherwise(3).alias("end"), F.lit("rule").alias("kind"), F.lit(None).cast("string").alias("of"), F.lit(None).cast("string").alias("grp"), F.when(k % 3 == 0, t).otherwise(F.substring(t, 1, 3)).alias("quote"))
    n, lk = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    ex = i.select(F.concat_ws(":", lk, n).alias("span_id"), F.lit("p").alias("page"), lk.alias("block_id"), n.cast("int").alias("start"), (n + 1).cast("int").alias("end"), F.when(n % 2 == 0, "compliant").otherwise("violating").alias("kind"), lk.alias("of"), F.concat_ws(":", lk, F.floor(n / 3).cast("int"), n % 2).alias("grp"), F.col("l_linestatus").alias("quote"))
    got = R.golden_rules(rules.unionByName(ex), blocks, "+")
    return got.select(F.col("span_id").cast("long").alias("span_id"), "whole", "statement", F.array_join("compliant", "|").alias("compliant"), F.array_join("violating", "|").alias("violating"))


@query("""
SELECT reason, count(*)::BIGINT AS n FROM (SELECT 'its rule is missing' AS reason FROM lineitem WHERE l_orderkey % 5 = 0 UNION ALL
    SELECT 'another span makes the same rule' FROM orders o WHERE o_orderkey % 5 <> 0 AND (SELECT count(*) FROM orders p WHERE p.o_orderkey % 5 <> 0 AND p.o_orderkey // 3 = o.o_orderkey // 3) > 1 UNION ALL
    SELECT 'a group of examples of both kinds' FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber // 4) AS n, sum(l_linenumber % 2) OVER (PARTITION BY l_orderkey, l_linenumber // 4) AS odd FROM lineitem) WHERE odd > 0 AND odd < n) GROUP BY reason
""")
def golden_refusal_census(spark, d):
    """Why a golden set would be refused: orders as rules, line items as examples."""
    null = F.lit(None).cast("string")
    o = read(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("span_id"), F.lit("p").alias("page"), F.lit("rule").alias("kind"), null.alias("of"), null.alias("grp"), F.floor(F.col("o_orderkey") / 3).cast("string").alias("uid"))
    n = F.col("l_linenumber")
    i = read(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", n).alias("span_id"), F.lit("p").alias("page"), F.when(n % 2 == 0, "compliant").otherwise("violating").alias("kind"), F.col("l_orderkey").cast("string").alias("of"), F.floor(n / 4).cast("string").alias("grp"), null.alias("uid"))
    return R.golden_refusals(o.unionByName(i)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT o_custkey AS page, (o_orderkey % 9)::VARCHAR AS s, o_orderkey % 3 <> 0 AS whole FROM orders WHERE o_orderkey % 2 = 0),
p AS (SELECT DISTINCT o_custkey AS page, (o_orderkey % 9)::VARCHAR AS s FROM orders WHERE o_orderkey % 4 < 2),
g AS (SELECT m.page, count(*) FILTER (WHERE whole AND p.s IS NOT NULL) AS hits, count(*) FILTER (WHERE whole AND p.s IS NULL) AS mh, count(*) FILTER (WHERE NOT whole) AS mp FROM m LEFT JOIN p ON p.page = m.page AND p.s = m.s GROUP BY m.page),
x AS (SELECT p.page, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.whole AND m.page = p.page AND m.s = p.s) GROUP BY p.page),
t AS (SELECT count(*) AS pages_swept, sum(coalesce(hits, 0)) AS hits, sum(coalesce(mh, 0)) AS mh, sum(coalesce(mp, 0)) AS mp, sum(coalesce(n, 0)) AS sp FROM (SELECT DISTINCT o_custkey AS page FROM orders WHERE o_custkey % 3 <> 0) w LEFT JOIN g USING (page) LEFT JOIN x USING (page))
SELECT pages_swept::BIGINT AS pages_swept, hits::BIGINT AS hits, mh::BIGINT AS missed_heading, mp::BIGINT AS missed_prose, sp::BIGINT AS spurious, (hits + mh + mp)::BIGINT AS golden_rules, round(hits / (hits + sp), 9) AS precision, round(hits / (hits + mh + mp), 9) AS recall_overall, round(hits / (hits + mh), 9) AS recall_reachable FROM t
""")
def heading_recall(spark, d):
    """What heading candidates find of the marked rules, on swept pages."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), "o_orderkey", (F.col("o_orderkey") % 9).cast("string").alias("statement"))
    marked = o.where("o_orderkey % 2 = 0").select("page", "statement", (F.col("o_orderkey") % 3 != 0).alias("whole"))
    got = E.recall_totals(E.span_recall(marked, o.where("o_orderkey % 4 < 2"), o.where("page % 3 <> 0")))
    return got.select("pages_swept", *[F.col(c).cast("long").alias(c) for c in ("hits", "missed_heading", "missed_prose", "spurious", "golden_rules")], *[F.round(c, 9).alias(c) for c in ("precision", "recall_overall", "recall_reachable")])


@query("SELECT coalesce(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))), 0)::BIGINT AS words FROM documents WHERE lang <> 'en' AND doc_id % 3 <> 0")
def unswept_words(spark, d):
    """Words of eligible pages that no one has swept."""
    from millrace.functions import text as X

    p = read(spark, d, "documents").select(F.col("doc_id").alias("page"), X.word_count(F.col("text")).alias("words"), (F.col("lang") != "en").alias("eligible"))
    return E.remaining_words(p, p.where("page % 3 = 0")).select(F.col("words").cast("long").alias("words"))


@query("SELECT doc_id AS page FROM documents WHERE lang = 'en' AND doc_id % 2 <> 0 AND doc_id % 3 <> 0 ORDER BY doc_id LIMIT 20")
def next_undrafted(spark, d):
    """The next twenty pages to draft."""
    p = read(spark, d, "documents").select(F.col("doc_id").alias("page"), (F.col("lang") == "en").alias("eligible"))
    return E.next_pages(p, p.where("page % 2 = 0"), p.where("page % 3 = 0"), 20)


@query("""
WITH i AS (SELECT o_custkey AS page, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 1 THEN 'heading' ELSE 'para' END AS kind, CASE o_orderkey // 3 % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'example' ELSE 'text' END AS t FROM orders),
m AS (SELECT *, CASE WHEN t <> 'text' THEN t WHEN kind = 'heading' THEN '' END AS mark FROM i)
SELECT label, count(*)::BIGINT AS n, sum(ord)::BIGINT AS ords FROM (SELECT ord, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS label FROM m) GROUP BY label
""")
def label_reach(spark, d):
    """The label each block stands under: a customer's orders as the blocks of a page."""
    k = F.col("o_orderkey")
    n = F.floor(k / 3) % 5
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), k.alias("ord"), F.when(k % 3 == 1, "heading").otherwise("para").alias("kind"), F.when(n == 0, "Correct").when(n == 1, " Incorrect").when(n == 2, "Example").otherwise("text").alias("plain"))
    return G.nearest_labels(b).groupBy("label").agg(F.count("*").alias("n"), F.sum("ord").cast("long").alias("ords"))


@query("""
WITH i AS (SELECT o_custkey AS page, o_orderkey AS k, o_orderstatus AS m, o_orderpriority AS f FROM orders),
s AS (SELECT * FROM i WHERE NOT (k % 3 = 0))
SELECT owner, count(*)::BIGINT AS n FROM (
    SELECT CASE WHEN EXISTS (SELECT 1 FROM i h WHERE h.page = s.page AND h.k % 4 = 1 AND h.m = s.m AND h.f = s.f) THEN 'heading and section' WHEN EXISTS (SELECT 1 FROM i h WHERE h.page = s.page AND h.k % 4 = 2 AND h.m = s.m) THEN 'section' ELSE 'none' END AS owner FROM s
) GROUP BY owner
""")
def unmarked_census(spark, d):
    """Instructions that nothing accounts for, and the marked heading they stand under: orders as sentences and rules."""
    i = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    s = i.select("page", F.col("k").cast("string").alias("block_id"), F.array("o_orderstatus", "o_orderpriority").alias("path"), F.lit(5).alias("start"), F.lit(9).alias("end"), F.concat(F.lit("say "), F.col("k").cast("string"), F.lit(" now.")).alias("text"))
    spans = i.where("k % 3 = 0").select("page", F.col("k").cast("string").alias("block_id"), F.lit(8).alias("start"), F.lit(20).alias("end"))
    spans = spans.unionByName(i.select("page", F.col("k").cast("string").alias("block_id"), F.lit(9).alias("start"), F.lit(20).alias("end")))
    deep, wide = i.where("k % 4 = 1"), i.where("k % 4 = 2")
    rule = lambda df, uid, path: df.select("page", F.lit(uid).alias("uid"), path.alias("path"), F.lit("a statement").alias("statement"), F.lit("").alias("specification"), F.array().cast(NONE).alias("preconditions"), F.lit(True).alias("heading"))
    rules = rule(deep, "heading and section", F.array("o_orderstatus", "o_orderpriority")).unionByName(rule(wide, "section", F.array("o_orderstatus")))
    return G.unmarked_directives(s, spans, rules).groupBy(F.coalesce("owner", F.lit("none")).alias("owner")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'zzz not there' ELSE substring(text, 3, 12) END AS q FROM documents),
w AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no such block' WHEN q = '' OR strpos(text, q) = 0 THEN 'quote not found' WHEN strpos(substring(text, strpos(text, q) + 1), q) > 0 THEN 'quote not unique' END AS refused, strpos(text, q) AS place FROM p)
SELECT doc_id AS ord, coalesce(refused, '') AS refused, CASE WHEN refused IS NULL THEN place - 1 ELSE -1 END::BIGINT AS start FROM w
""")
def pointer_checks(spark, d):
    """Quotes that point into documents, refused or placed."""
    docs = read(spark, d, "documents").select(F.col("doc_id"), "text")
    pointers = docs.select(F.col("doc_id").alias("page"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise("b").alias("block_id"), F.when(F.col("doc_id") % 5 == 0, "zzz not there").otherwise(F.substring("text", 3, 12)).alias("quote"))
    blocks, titles = docs.select(F.col("doc_id").alias("page"), F.lit("b").alias("block_id"), F.col("text").alias("plain")), docs.select(F.col("doc_id").alias("page"), F.lit("a title of no quote").alias("title"))
    got = G.resolved_pointers(pointers, blocks, titles)
    return got.select("ord", F.coalesce("refused", F.lit("")).alias("refused"), F.coalesce("start", F.lit(-1)).cast("long").alias("start"))


@query("""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'unreviewed' ELSE 'ambiguous_resolvable' END AS clarity, CASE WHEN c_custkey % 3 = 0 THEN 'as read' ELSE ' ' END AS spec FROM customer),
w AS (SELECT k, clarity, CASE WHEN k % 13 = 0 THEN 'field not editable' WHEN k % 11 = 0 THEN 'unknown unit' WHEN k % 5 = 4 THEN 'status not settable' WHEN k % 5 <> 3 AND clarity = 'ambiguous_resolvable' AND trim(spec) = '' THEN 'interpretation missing' WHEN k % 5 < 2 AND clarity = 'unreviewed' THEN 'clarity not set' END AS why,
    CASE k % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'amended' WHEN 2 THEN 'rejected' WHEN 3 THEN NULL ELSE 'orphaned' END AS st FROM r)
SELECT k AS uid, coalesce(why, '') AS reject_reason, CASE WHEN why IS NULL AND st IS NOT NULL THEN st ELSE 'proposed' END AS status, CASE WHEN why IS NULL AND st IS NOT NULL THEN '[a, b] said' || CASE WHEN k % 4 = 0 THEN ' (hasty)' ELSE '' END ELSE '' END AS note FROM w
""")
def patch_checks(spark, d):
    """Reviewers' patches, taken or refused: customers as rules with one patch each."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    text = lambda v: F.lit(v).cast("string")
    rules = c.select(k.alias("uid"), text("proposed").alias("status"), text("sentence").alias("unit"), F.when(k % 2 == 0, "unreviewed").otherwise("ambiguous_resolvable").alias("clarity"), text("presence").alias("direction"), text("MUST").alias("modality"), F.when(k % 3 == 0, "as read").otherwise(" ").alias("specification"))
    status = F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "amended").when(k % 5 == 2, "rejected").when(k % 5 == 4, "orphaned")
    patches = c.select(
        k.alias("uid"), F.when(k % 13 == 0, F.array(F.lit("uid"), F.lit("note"))).otherwise(F.array(F.lit("note"), F.lit("unit"))).alias("fields"), status.alias("status"), F.when(k % 11 == 0, "stanza").alias("unit"), text(None).alias("clarity"), text(None).alias("direction"), text(None).alias("modality"), text(None).alias("specification"),
        text("said").alias("note"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("reasons"), F.when(k % 4 == 0, 100).otherwise(9000).alias("elapsed_ms"),
    )
    got = L.patched(rules, patches)
    return got.select("uid", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "status", F.coalesce("note", F.lit("")).alias("note"))


@query("""
SELECT doc_id AS page, sha256('PAGE: ' || doc_id || chr(10) || 'TITLE: ' || lang || chr(10) || chr(10) || string_agg('[' || n || '] ' || CASE n % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'H2 ⟨candidate⟩' ELSE 'H2' END WHEN 1 THEN 'P' WHEN 2 THEN 'LI. ordered' ELSE 'CELL 1,2' END || '  ' || t, chr(10) ORDER BY n)) AS sha256
FROM (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, 'x ' || unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id, lang
""")
def rendered_pages(spark, d):
    """Documents as the plain pages that a drafter reads."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("page"), "lang", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    kind = F.element_at(F.array(*map(F.lit, ("heading", "para", "li", "cell"))), (F.col("n") % 4 + 1).cast("int"))
    blocks = docs.select("page", F.col("n").alias("ord"), F.col("n").cast("string").alias("block_id"), kind.alias("kind"), F.lit(2).alias("level"), F.lit(1).alias("depth"), F.lit(True).alias("ordered"), F.array(F.lit(1), F.lit(2)).alias("cell"), F.concat(F.lit("x "), "t").alias("plain"))
    got = B.rendered(blocks, blocks.where("page % 3 = 0").select("page", "block_id"), docs.select("page", F.col("lang").alias("title")).distinct())
    return got.select("page", F.sha2("text", 256).alias("sha256"))


@query("""
SELECT verdict, settled, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'rule' ELSE 'not_rule' END ELSE '' END AS verdict, o_orderkey % 30 = 0 AS settled FROM orders) GROUP BY verdict, settled
""")
def second_readings(spark, d):
    """Items of one drafter that another family has read."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    items = o.select(F.col("o_custkey").alias("page"), k.alias("rid"), F.when(k % 2 == 0, "single").otherwise("example").alias("kind"))
    verdicts = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("page"), k.alias("rid"), F.when(k % 5 == 0, "rule").otherwise("not_rule").alias("verdict"))
    return G.second_reading(items, verdicts).groupBy(F.coalesce("verdict", F.lit("")).alias("verdict"), "settled").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT o_orderkey AS uid, o_custkey AS page FROM orders WHERE (o_orderkey % 4 = 0 OR o_orderkey % 6 = 1) AND o_orderkey % 5 <> 0),
s AS (SELECT l_orderkey AS uid, l_linenumber AS rid, l_quantity AS score FROM lineitem WHERE l_linenumber % 2 = 1),
b AS (SELECT uid, rid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid DESC) AS n FROM s) WHERE n = 1)
SELECT c.uid, coalesce(b.rid, 0)::BIGINT AS rid FROM c LEFT JOIN b USING (uid)
""")
def dropped_candidate_cover(spark, d):
    """Kept candidates that no rule of the consensus marks, and the agreed rule that restates them."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    page = F.col("o_custkey").alias("page")
    candidates = o.select(page, k.alias("uid"), F.when(k % 4 == 0, "accepted").when(k % 6 == 5, "rejected").otherwise("proposed").alias("status"), (k % 6 == 1).alias("paired"))
    seeds = o.where("o_orderkey % 5 = 0").select(page, (-k).alias("rid"), k.alias("seed_uid"), F.lit(True).alias("agreed"))
    i = read(spark, d, "lineitem").join(o.select("o_orderkey", page), F.col("l_orderkey") == k)
    rules = i.select("page", (k * 10 + F.col("l_linenumber")).alias("rid"), F.lit(None).cast("long").alias("seed_uid"), (F.col("l_linenumber") % 2 == 1).alias("agreed"))
    scores = i.select("page", k.alias("uid"), (k * 10 + F.col("l_linenumber")).alias("rid"), F.col("l_quantity").cast("double").alias("score"))
    got = G.dropped_candidates(candidates, seeds.unionByName(rules), scores)
    return got.select("uid", F.coalesce(F.col("rid") - F.col("uid") * 10, F.lit(0)).cast("long").alias("rid"))


@query("""
SELECT name, key, problem FROM (SELECT 'nation' AS name, n_name AS key, 'extra' AS problem FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'nation', n_name, 'missing' FROM nation WHERE n_nationkey % 3 = 2)
""")
def vocabulary_check(spark, d):
    """Keys that a stored vocabulary has too many or too few."""
    n = read(spark, d, "nation").select(F.lit("nation").alias("name"), F.col("n_name").alias("key"), "n_nationkey")
    return E.vocabulary_drift(n.where("n_nationkey % 3 <> 2"), n.where("n_nationkey % 3 <> 1"))
