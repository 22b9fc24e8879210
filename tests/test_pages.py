import pytest
from conftest import rows_of, rows_of_sql

from millrace.functions import html as H
from millrace.operators import audit as A
from millrace.operators import blocks as K
from millrace.operators import structure as B
from millrace.plans import inventory
from millrace.plans import pages as plans

PAGE = """lead text
# Title ##
> one
plain in between
> two

- item
  - nested
    2. deep and ordered
- 
| a | | b |
|---|---|---|
| 1 |
after the table
||x||y||

| fresh |
```
# no heading
- still an item
```
### Skips a level
same
same
## Back
same"""


def blocks_of(page, text):
    return [dict(zip(K.BLOCK.names, b, strict=True)) for b in K.page_blocks(page, text)]


def test_page_grammar():
    got = blocks_of("p", PAGE)
    assert [(b["kind"], b["plain"], b["level"], b["depth"], b["ordered"], b["row"], b["col"]) for b in got] == [
        ("para", "lead text", 0, 0, False, None, None), ("heading", "Title", 1, 0, False, None, None),
        ("para", "plain in between", 1, 0, False, None, None), ("quote", "one two", 1, 0, False, None, None),
        ("li", "item", 1, 0, False, None, None), ("li", "nested", 1, 1, False, None, None), ("li", "deep and ordered", 1, 2, True, None, None),
        ("cell", "a", 1, 0, False, 0, 0), ("cell", "b", 1, 0, False, 0, 2), ("cell", "1", 1, 0, False, 1, 0), ("para", "after the table", 1, 0, False, None, None),
        ("cell", "x", 1, 0, False, 2, 0), ("cell", "y", 1, 0, False, 2, 2), ("cell", "fresh", 1, 0, False, 0, 0),
        ("para", "```", 1, 0, False, None, None), ("para", "# no heading", 1, 0, False, None, None), ("li", "still an item", 1, 0, False, None, None), ("para", "```", 1, 0, False, None, None),
        ("heading", "Skips a level", 3, 0, False, None, None), ("para", "same", 3, 0, False, None, None), ("para", "same", 3, 0, False, None, None),
        ("heading", "Back", 2, 0, False, None, None), ("para", "same", 2, 0, False, None, None),
    ]
    assert [b["ord"] for b in got] == list(range(len(got)))
    assert [b["path"] for b in got if b["plain"] == "same"] == [["Title", "Skips a level"]] * 2 + [["Title", "Back"]]
    assert [b["occurrence"] for b in got if b["plain"] == "same"] == [0, 1, 0]
    assert len({b["block_id"] for b in got}) == len(got) and all(len(b["block_id"]) == 12 for b in got)
    assert [b["line"] for b in got if b["kind"] == "quote"] == [2]


def test_block_ids_outlive_changes_elsewhere():
    ids = {b["plain"]: b["block_id"] for b in blocks_of("p", "# A\none\n\n## B\ntwo")}
    later = {b["plain"]: b["block_id"] for b in blocks_of("p", "# A\nnew\n\none\n\n## B\ntwo\n- x")}
    assert all(later[k] == v for k, v in ids.items())
    assert blocks_of("q", "# A")[0]["block_id"] != ids["A"]


def test_marks_lie_over_the_plain_text(spark):
    df = spark.createDataFrame([("p", "# a **b** `c`\n- see [*this* one](x/y)\n- ****\n"), ("q", None), ("r", ""), ("p", "twice")], "page string, text string")
    got = K.parse(df).collect()
    assert sorted({r.page for r in got}) == ["p"] and len(got) == 4
    for r in got:
        for m in r.marks:
            assert 0 <= m.start < m.end <= len(r.plain) and (m.href is not None) == (m.kind == "link")
    assert [(m.kind, r.plain[m.start : m.end]) for r in got if r.kind == "li" for m in r.marks] == [("link", "this one"), ("em", "this")]


def test_locks_tell_what_changed(spark):
    def lock(*pages):
        return K.lock(K.parse(spark.createDataFrame(pages, "page string, text string")))

    old = lock(("a", "# A\nx"), ("b", "# B"), ("c", "# C\n**x**"))
    assert {r.page: r.blocks for r in old.collect()} == {"a": 2, "b": 1, "c": 2}
    assert K.lock_changes(old, lock(("c", "# C\n**x**"), ("a", "# A\nx"), ("b", "# B"))).count() == 0
    now = lock(("a", "# A\ny"), ("c", "# C\nx"), ("d", "# D"))
    assert {(r.page, r.state) for r in K.lock_changes(old, now).collect()} == {("a", "stale"), ("b", "gone"), ("c", "stale"), ("d", "new")}


def test_normalised_pages_put_headings_back(spark):
    raw = "Lost heading\r\n\r\n### Rule  \r\n\r\nbody"
    r = B.normalised_pages(spark.createDataFrame([("p", raw), ("q", "## Kept\n")], "path string, raw string")).orderBy("path").collect()
    assert r[0].text == "## Lost heading\n\n### Rule\n\nbody\n" and r[0].promotions == 1 and r[1].promotions == 0
    again = B.normalised_pages(spark.createDataFrame([("p", r[0].text)], "path string, raw string")).collect()[0]
    assert (again.text, again.sha256, again.promotions) == (r[0].text, r[0].sha256, 0)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><h1>Site</h1><article><h2>In article</h2></article><main><h1>T</h1><p>a</main><p>outside", "# T\n\na\n"),
        ("<main><p>no heading here</main><article><h2>T</h2><p>b</article>", "## T\n\nb\n"),
        ("<div id=main-content><h1>T</h1>x</div><p>y", "# T\n\nx\n"),
        ("<h1>T</h1><form><p>hidden<p>too</form><p>shown", "# T\n\nshown\n"),
        ("<div><form><p>never closed</div><h1>T</h1><p>shown", "# T\n\nshown\n"),
        ("<h1>T</h1><p>a</p><h2>Release notes:</h2><p>gone</p><h2>Also gone</h2>", "# T\n\na\n"),
        ("<h1>T</h1><div class='x sr-only'>no</div><div role=navigation>no</div><p aria-hidden=true>no</p><p>yes", "# T\n\nyes\n"),
        ("<h1><strong><em>All</em></strong></h1><h2>Part <em>only</em></h2>", "# All\n\n## Part *only*\n"),
        ("<h1>T</h1><ol><li>one<ul><li>in <b>bold</b><li>next</ul><li>two</ol>", "# T\n\n1. one\n  - in **bold**\n  - next\n2. two\n"),
        ("<h1>T</h1><ul><li><h4>Card</h4><p>text</p></ul>", "# T\n\n- Card text\n"),
        ("<h1>T</h1><table><tr><th>h<th>i<th>j<tr><td>1<td><a href='#x'>2</a></table>", "# T\n\n| h | i | j |\n| --- | --- | --- |\n| 1 | 2 |  |\n"),
        ("<h1>T</h1><p>a <a href='/x?y=1'>b</a> <a href=''>c</a> <a href='z'></a>d<sup>2</sup>", "# T\n\na [b](https://s.au/x?y=1) c d2\n"),
        ("<h1>T</h1><blockquote><p>one</p><p>two</p></blockquote><pre>\n x  y\n z\n</pre><hr><p>e", "# T\n\n> one two\n\n```\n x  y\n z\n```\n\n---\n\ne\n"),
        ("<h1>T</h1><p><b>open<br><p>para</p><script>var x='</p>'</script>&amp; tail", "# T\n\n**open**\n\npara\n\n& tail\n"),
        ("<h1>T</h1><dl><dt>a<dd>b</dl><p>c&nbsp; d<br>e", "# T\n\na\n\nb\n\nc d \ne\n"),
        ("<h1>T</h1><p>café</p>", "# T\n\ncafé\n"),
    ],
)
def test_markdown_of_pages(html, want):
    assert H.to_markdown(html, "https://s.au/p") == want


def test_references_without_semicolon_are_text(spark, tmp_path):
    import duckdb

    html = "<article><h1>Of A &amp;&amp</h1><p><b>cut &quo<br>gone</p><p>x &lt y &#x2 &ampfoo; &bar; &amp;lt; &lt;i&gt; &#x27;q&quot; a&b & c</p></article>"
    want = "# Of A &&amp\n\n**cut &quo**\n\nx &lt y &#x2 &ampfoo; &bar; &lt; <i> 'q\" a&b & c\n"
    assert H.to_markdown(html.replace("<br>gone", "")) == want
    assert H.source_headings("<h1>A &amp</h1>") == [(1, "A &amp", False)]
    html = html.replace("<br>gone</p>", "<br>")
    spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(plans.html_to_markdown(spark, str(tmp_path))) == rows_of_sql(con, inventory.oracle_sql()["html_to_markdown"])


def test_pages_without_content_are_refused(spark):
    for html, error in (("", "no content"), ("<p>text", "no heading"), ("<form><h1>x</h1></form>", "no content"), ("<h1>Release notes</h1><p>x", "no content")):
        with pytest.raises(H.ExtractionError, match=error):
            H.to_markdown(html)
    df = spark.createDataFrame([(1, "<h1>a"), (2, "<p>b"), (3, None)], "i int, html string")
    got = {r.i: tuple(r.m) for r in df.select("i", H.markdown_or_error("html", "html").alias("m")).collect()}
    assert got == {1: ("# a\n", None), 2: (None, "no heading"), 3: (None, None)}


def test_source_headings():
    html = "<h1>Style Manual</h1><main><h1>T</h1><ul><li><h3>Card</h3></ul><h2>Don<span>’</span>t  do\n it</h2><h2></h2><nav><h2>no</h2></nav><h2>About this page</h2><h2>gone</h2></main>"
    assert H.source_headings(html) == [(1, "T", False), (3, "Card", True), (2, "Don’t do it", False)]
    assert H.source_headings("<article><h2>a</article><h2>b") == [(2, "a", False)]
    assert H.source_headings("no headings") == []


def test_audit_counts_repeats_once_each(spark):
    html = "<main><h1>T</h1><h2>Same</h2><h2>Same</h2><h2>Same</h2><h3>Moved</h3><ul><li><h4>Card</h4></ul><h2>Lost</h2></main>"
    md = "# T\n\n## Same\n\n## Same\n\n## Moved\n\n- Card\n\n## New\n"
    df = spark.createDataFrame([("p", html, md), ("q", "<p>none", ""), ("r", None, None)], "page string, html string, md string")
    rows = {r.page: r for r in A.extraction(df).collect()}
    p = rows["p"]
    assert (p.sections, p.cards, p.headings, p.missing, p.extra, p.levels) == (6, 1, 5, 2, 1, 1)
    assert all(tuple(rows[x])[1:] == (0,) * 6 for x in "qr")
    states = A.compared(A.source_headings(df).where("NOT card"), A.markdown_headings(df)).collect()
    assert {(r.title, r.k, r.state) for r in states if r.state != "same"} == {("Same", 3, "missing"), ("Lost", 1, "missing"), ("New", 1, "extra"), ("Moved", 1, "level")}


def test_census_by_grouping_sets(spark):
    rows = [("rule", "verb", f"t{i % 3}") for i in range(5)] + [("section", None, "s"), ("rule", "modal", "m")]
    got = {(r.kind, r.branch): (r.n, r.share, r.examples) for r in A.census(spark.createDataFrame(rows, "kind string, branch string, title string"), ["kind", "branch"], top=2).collect()}
    assert got[("*", "*")][:2] == (7, 1.0) and got[("rule", "*")][0] == 6 and got[("rule", "verb")] == (5, round(5 / 7, 6), ["t0", "t1"])
    assert got[("section", "")][0] == 1 and got[("*", "verb")][2] == ["t0", "t1"]
