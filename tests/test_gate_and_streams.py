import datetime
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.functions import udfs
from millrace.operators import evaluate as E
from millrace.sources import readers
from millrace.streaming import buffer

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- the gate under a time budget


def test_a_catastrophic_pattern_costs_its_own_page_only(spark):
    pages = spark.createDataFrame([(1, "aa bad aa"), (2, "a" * 40 + "!"), (3, "bad bad"), (4, None)], "doc_id int, text string")
    matchers = [("slow", "regex", {"pattern": r"(?:a+)+$"}), ("bad", "literal_set", {"terms": ["bad"]}), ("silent", "regex", {"pattern": "zzz"})]
    began = time.time()
    got = udfs.count_findings(pages, matchers, seconds=0.3).collect()
    assert time.time() - began < 30
    rows = {(r.doc_id, r.rule_uid): (r.findings, r.error) for r in got}
    assert rows == {(1, "slow"): (1, None), (2, "slow"): (0, "over 0.3 s on one page"), (1, "bad"): (1, None), (3, "bad"): (2, None)}
    counts = udfs.count_findings(pages, matchers, seconds=0.3)
    rules = spark.createDataFrame([("slow", 1.0), ("bad", 1.0), ("silent", 1.0)], "rule_uid string, budget double")
    gate = {r.rule_uid: (r.findings, r.pages_hit, r.error, r.over_budget) for r in E.timed_gate(counts, rules, F.lit(100)).collect()}
    assert gate == {"slow": (1, 1, "over 0.3 s on one page", None), "bad": (3, 2, None, True), "silent": (0, 0, None, False)}


def test_the_alarm_is_put_back():
    import signal

    before = signal.getsignal(signal.SIGALRM)
    with pytest.raises(udfs.OverBudget), udfs.time_budget(0.05):
        while True:
            pass
    with udfs.time_budget(5):
        pass
    assert signal.getsignal(signal.SIGALRM) == before and signal.getitimer(signal.ITIMER_REAL)[0] == 0


# ---- sitemaps


def test_sitemap_forms():
    url = "https://h/sitemap.xml"
    assert readers.sitemap_rows('<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://h/a </loc><lastmod>1</lastmod></url><url><lastmod>2</lastmod></url></urlset>', url) == [("https://h/a", "1", False)]
    assert readers.sitemap_rows("<sitemapindex><sitemap><loc>https://h/b.xml</loc></sitemap></sitemapindex>", url) == [("https://h/b.xml", None, True)]
    assert readers.sitemap_rows("<urlset><url><loc>x</loc>", url) == [] and readers.sitemap_rows("<?xml version='1.0'?><feed><url><loc>x</loc></url></feed>", url) == [] and readers.sitemap_rows(None, url) == []
    table = '<table><tr><td>first table</td></tr></table><table class="x sitemap"><tr><th>URL<tr><td><a href="/a">a</a><td> 2024 <tr><td>/plain<tr><td><a href="/sitemap.xml?page=2">2</a><tr></table><ul class=pager><li><a href="/sitemap.xml?page=3">3</a><li><a href="/sitemap.xml">self</a><li><a href="/other">no</a></ul>'
    assert readers.sitemap_rows(table, url) == [("https://h/a", "2024", False), ("https://h/plain", None, False), ("https://h/sitemap.xml?page=2", None, True), ("https://h/sitemap.xml?page=3", None, True)]
    assert readers.sitemap_rows("<p>no table <a href='/sitemap.xml?page=2'>x</a>", url) == []
    assert H.sitemap_link("https://h/EN/Sitemap") and H.sitemap_link("/sitemap/x?a=1&PAGE=2") and not H.sitemap_link("/sitemap-help")


def test_sitemaps_are_followed_once(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    pages = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    bodies = [("s", index("a", "b", "gone")), ("a", pages("p1", "p2")), ("b", index("s", "c", "b")), ("c", pages("p2", "p3")), ("alone", pages("p9")), ("c", None)]
    got = readers.crawled_sitemaps(spark.createDataFrame(bodies, "url string, body string"), "s")
    assert {tuple(r) for r in got.collect()} == {("a", 1, "p1", None), ("a", 1, "p2", None), ("c", 2, "p2", None), ("c", 2, "p3", None)}
    assert readers.crawled_sitemaps(spark.createDataFrame([], "url string, body string"), "s").count() == 0


# ---- blocks of a stream


def test_cut():
    assert buffer.cut("a\n\n\n\nb\n\nc", 0, 0, "\n\n", False) == ([(0, 0, "a"), (2, 5, "b")], "c", 8, 3)
    assert buffer.cut("c", 8, 3, "\n\n", True) == ([(3, 8, "c")], "", 11, 4)


def test_blocks_wait_for_their_end(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        t = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
        schema = "doc string, seq int, at timestamp, piece string, final boolean"
        batches = [
            [("d", 0, t(0), "one\n", False), ("e", 0, t(0), "held", False)], [("d", 2, t(1), "three", False), ("d", 0, t(1), "one\n", False)], [("d", 1, t(2), "\ntwo\n\n", False)],
            [("d", 3, t(3), "!\n\nlast", True), ("f", 0, t(400), "x", True)], [("f", 1, t(800), "after the end", False)], [("e", 1, t(900), " rest\n\n", False), ("f", 2, t(900), "", False)],
        ]
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
            time.sleep(1.1)  # files are taken by their time
        source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run = buffer.blocks(source, "1 second", 5_000).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(180)
        got = sorted(tuple(r) for r in spark.table("cut").collect())
        assert got == [("d", 0, 0, "one", "closed"), ("d", 1, 5, "two", "closed"), ("d", 2, 10, "three!", "closed"), ("d", 3, 18, "last", "final"), ("e", 0, 0, "held", "late"), ("e", 1, 4, " rest", "closed"), ("f", 0, 0, "x", "final")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
