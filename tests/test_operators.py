import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import udfs
from millrace.operators import evaluate as E
from millrace.operators import ledger as L
from millrace.operators import snapshot as S
from millrace.operators import structure as B
from millrace.sources import readers, sinks
from millrace.streaming import replay


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\r\nb\rc", "a\nb\nc\n"), ("a b​c﻿", "a bc\n"), ("x  \t\n\n\n\n\ny ", "x\n\ny\n"), ("", "\n"), (" \n", "\n")],
)
def test_normalise_text(spark, raw, want):
    got = one(spark, X.normalise_text(F.col("t")), t=raw)
    assert got == want
    assert one(spark, X.normalise_text(F.col("t")), t=got) == got


@pytest.mark.parametrize(
    ("title", "kind", "form"),
    [
        ("Write this", "example", ""), ("Release notes", "boilerplate", ""), ("Hyphens", "section", ""), ("Don’t use italics", "rule", "negative_imperative"),
        ("Use plain words", "rule", "imperative"), ("Titles must be short", "rule", "modal"), ("Nouns join clauses", "section", ""), ("Jo Smith, editor (on loan)", "boilerplate", ""), ("", "boilerplate", ""),
    ],
)
def test_heading_kind(spark, title, kind, form):
    got = one(spark, X.heading_kind(F.col("t")), t=title)
    assert (got.kind, got.form) == (kind, form)


@pytest.mark.parametrize(("s", "form", "want"), [("You must not shout", "modal", "MUST_NOT"), ("Avoid jargon", "imperative", "SHOULD_NOT"), ("Use verbs", "imperative", "MUST"), ("Verbs", "exemplified", "SHOULD"), ("We prefer verbs", "x", "PREFER")])
def test_modality(spark, s, form, want):
    assert one(spark, X.modality(F.col("s"), F.col("f")), s=s, f=form).modality == want


@pytest.mark.parametrize(("s", "want"), [("Generally, avoid it.", "negative"), ("Use it.", "imperative"), ("If it is long enough, write less", "conditional"), ("It should go", "modal"), ("It goes", None), ("...", None)])
def test_directive_cue(spark, s, want):
    assert one(spark, X.directive_cue(F.col("s")), s=s) == want


def test_small_text_functions(spark):
    assert one(spark, X.clean_example(F.col("t")), t="Use [a [b](c)](d) now [gloss]") == "Use a b now"
    assert one(spark, X.composed_text(F.col("t")), t="cafe\u0301  \r\n") == "café\n" == one(spark, X.normalise_text(F.col("t")), t="café")
    assert one(spark, X.composed_statement(F.col("t")), t="Cafe\u0301  ‘x’") == "Café 'x'"
    assert one(spark, X.drafter_id(F.col("a"), F.col("b"), "medium"), a="m", b="high") == "m@high"
    assert tuple(one(spark, X.split_drafter(F.col("a"), "medium"), a="m")) == ("m", "medium") and tuple(one(spark, X.split_drafter(F.col("a"), "medium"), a="m@high")) == ("m", "high")
    assert one(spark, X.locate(F.col("b"), F.col("q")), b="it’s here", q="it's") == 0
    assert one(spark, X.locate(F.col("b"), F.col("q")), b="aa", q="a") is None
    assert one(spark, X.initials(F.col("t")), t="j. o'neil!") == "JONEIL"
    assert one(spark, X.initials(F.col("t")), t="!") == "ANON"
    assert one(spark, X.heading_title(F.col("t")), t="**_Title_**") == "Title"
    assert one(spark, X.url_path(F.col("t")), t="https://a.b/x/y/?q=1") == "x/y.md"
    assert one(spark, X.url_path(F.col("t")), t="https://a.b") == "index.md"
    a = spark.range(1).select(X.anchor(F.lit("a😀bcd"), F.lit(1), F.lit(3), 1).alias("a")).first()["a"]
    assert tuple(a) == ("😀b", "a", "c")


def test_digests(spark):
    got = spark.range(1).select(udfs.uid(F.lit("p.md"), F.array(F.lit("A"), F.lit("B")), F.lit("Use it")).alias("u"), udfs.sweep_slice(F.lit("p.md")).alias("s"), udfs.held_out(F.lit("p.md")).alias("h"), udfs.nfc(F.lit("é")).alias("n")).first()
    assert got.u == hashlib.blake2s("p.md\0A > B\0Use it".encode(), digest_size=8).hexdigest()
    assert got.s == int.from_bytes(hashlib.blake2s(b"p.md", digest_size=4).digest(), "big") % 7
    assert got.h == (hashlib.blake2s(b"p.md").digest()[0] % 16 == 0)
    assert got.n == "é"


def test_heading_tree_is_the_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(60):
        stack = []
        for line in range(rng.randint(1, 15)):
            level, title = rng.randint(1, 6), f"t{line}"
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            rows.append((page, line, level, title))
            want[page, line] = [t for _, t in stack]
    got = B.ancestry(spark.createDataFrame(rows, "page int, line int, level int, title string")).collect()
    assert {(r.page, r.line): r.path for r in got} == want


def test_headings_and_bodies(spark):
    page = "# A\nx\n```\n# no\n```\n## B ##\n\ny\n\nz\n####### seven"
    lines = B.lines(spark.createDataFrame([("p", page)], "page string, text string"))
    h = B.headings(lines)
    assert [(r.line, r.level, r.title) for r in h.orderBy("line").collect()] == [(0, 1, "A"), (5, 2, "B")]
    assert {r.line: r.body for r in B.bodies(lines, h).collect()} == {0: "x\n```\n# no\n```", 5: "y\n\nz\n####### seven"}


def test_offsets(spark):
    docs = spark.createDataFrame([(1, "aé\n\n\n\n😀b\n\n "), (2, ""), (3, None)], "doc_id int, text string")
    for blocks in (B.text_blocks(docs), B.text_blocks_narrow(docs)):
        got = blocks.collect()
        assert sorted((r.block, r.start, r.end, r.text) for r in got) == [(0, 0, 2, "aé"), (2, 6, 8, "😀b")]


def test_example_blocks(spark):
    rows = [(0, "heading", "Not this", ["A", "Not this"]), (1, "li", "x", ["A", "Not this"]), (2, "li", "y", ["A", "Not this"]), (3, "para", "prose", ["A", "Not this"]), (4, "heading", "B", ["B"]), (5, "para", "text", ["B"]), (6, "para", "Correct:", ["B"]), (7, "para", "good", ["B"]), (8, "li", "late", ["B"])]
    df = spark.createDataFrame([("p", *r) for r in rows], "page string, ord int, kind string, plain string, path array<string>")
    assert {r.ord for r in B.example_blocks(df).where("example").collect()} == {1, 2, 7}


def test_matchers(spark):
    docs = spark.createDataFrame([(1, "the ‘old people’ and old people, not old"), (2, None), (3, "Old people’s")], "doc_id int, text string")
    got = udfs.find_spans(docs, [("a", "literal_set", {"terms": ["old", "old people"]}), ("b", "regex", {"pattern": "x*"})]).collect()
    assert sorted((r.doc_id, r.begin, r.stop, r.quote) for r in got) == [(1, 21, 31, "old people"), (1, 37, 40, "old"), (3, 0, 10, "Old people")]
    got = udfs.find_spans(docs, [("a", "literal_set", {"terms": ["old"], "unless": ["not"], "window": 4, "skip_quoted": False})]).collect()
    assert sorted(r.begin for r in got if r.doc_id == 1) == [5, 21]
    for method, spec in [("regex", {}), ("regex", {"pattern": "("}), ("regex", {"pattern": "a", "terms": []}), ("literal_set", {"terms": []}), ("classifier", {}), ("regex", {"pattern": "a", "window": 201})]:
        with pytest.raises(udfs.MatcherError):
            udfs.check_matcher(method, spec)


def test_inline_marks():
    plain, marks = udfs.inline("a **b [c](u)** `d*` *e* **f")
    assert plain == "a b c d* e **f"
    assert [(plain[a:b], k, h) for a, b, k, h in marks] == [("b c", "strong", None), ("c", "link", "u"), ("d*", "code", None), ("e", "em", None)]


def test_globs_and_eligibility(spark):
    for glob, path, want in [("a/**", "a", True), ("a/**", "a/b/c", True), ("a/*", "a/b/c", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a?/b", "ac/b", True), ("a.b", "axb", False), ("**", "q/r", True)]:
        assert bool(re.match(S.glob_regex(glob), path)) == want, (glob, path)
    got = S.eligibility(spark.createDataFrame([("a/b",), ("z",)], "path string"), [("a/**", True, False), ("a/b", False, False)]).collect()
    assert {(r.path, r.glob, r.eligible) for r in got} == {("a/b", "a/**", True), ("z", "unclassified", False)}  # as many slashes, longer


def test_change_kinds(spark):
    def kind(n, changed, more=0):
        old = spark.createDataFrame([(str(i), "a", "m") for i in range(n)], "path string, sha256 string, lastmod string")
        new = spark.createDataFrame([(str(i), "b" if i < changed else "a", "m") for i in range(n + more)], "path string, sha256 string, lastmod string")
        return S.change_summary(S.diff(old, new)).first()

    assert kind(10, 8).kind == "editorial"
    assert kind(10, 9).kind == "extractor_upgrade"
    assert kind(10, 9, 1).kind == "editorial"
    assert kind(0, 0, 2).kind == "initial"
    assert kind(3, 0).unchanged == 3


def plain_reconcile(new, old):
    live = {r[0]: r for r in old if r[5] not in L.DEAD}
    made, used, out = {c[0] for c in new}, set(), []
    for c in sorted(new, key=lambda c: (c[1], c[5], c[0])):
        uid, page, parent, statement, body, _, positional, sup = c
        if uid in live:
            used.add(uid)
            out.append(("unchanged" if live[uid][4].strip() == body[:1200].strip() else "body_altered", uid, uid))
            continue
        if sup in live and sup not in used:
            used.add(sup)
            out.append(("reworded", sup, uid))
            continue
        free = [r for u, r in sorted(live.items()) if u not in used and u not in made]
        tied, kind = [r for r in free if r[3] == statement], "rehomed"
        if len(tied) > 1 and sum(r[1] == page for r in tied) == 1:
            tied = [r for r in tied if r[1] == page]
        if not tied and positional:
            tied, kind = [r for r in free if (r[1], r[2]) == (page, parent)], "reworded"
        if len(tied) == 1:
            used.add(tied[0][0])
            out.append((kind, tied[0][0], uid))
        elif tied:
            out.append(("ambiguous", tied[0][0], uid))
        else:
            out.append(("added", None, uid))
    return sorted((str(x) for x in out + [("orphaned", u, None) for u in live if u not in used and u not in made]))


def test_reconcile(spark):
    rng = random.Random(3)
    old = [(f"o{i}" if i % 3 else f"k{i}", rng.choice("pq"), rng.choice("xyz"), f"s{rng.randint(0, 9)}", "b", rng.choice(["accepted", "accepted", "orphaned"])) for i in range(25)]
    new = [(f"n{i}" if i % 3 else f"k{i}", rng.choice("pq"), rng.choice("xyz"), f"s{rng.randint(0, 12)}", rng.choice("bc"), i, rng.random() < 0.7, rng.choice([None, None, f"o{i}"])) for i in range(25)]
    c = spark.createDataFrame(new, "uid string, page string, parent string, statement string, body string, line int, positional boolean, supersedes string")
    r = spark.createDataFrame(old, "uid string, page string, parent string, statement string, body string, status string")
    assert sorted(str(tuple(x)) for x in L.reconcile(c, r).collect()) == plain_reconcile(new, old)


def test_pace_boundary(spark):
    rows = [(1, "a", "2024-01-01 23:55:00"), (2, "b", "2024-01-02 00:05:00"), (3, "a", "2024-01-02 00:15:00.000001"), (4, "a", "2024-01-05 00:00:00")]
    ops = spark.createDataFrame(rows, "i int, p string, t string").withColumn("t", F.to_timestamp("t"))
    assert {r.page: (r.n_ops, r.micros) for r in E.pace(ops, "p", "t", "i").collect()} == {"a": (3, 0), "b": (1, 600_000_000)}


def test_many_small_groups_are_one_pass(spark):
    """A pandas frame a group cost milliseconds for each; rows without line or page come last, as they did."""
    n = 3000
    new = spark.range(n).selectExpr("concat('n', id) AS uid", "'p' AS page", "concat('h', id) AS parent", "concat('Use x', id) AS statement", "'b' AS body", "CAST(NULL AS INT) AS line", "id % 2 = 0 AS positional", "CAST(NULL AS STRING) AS supersedes")
    old = spark.range(n).selectExpr("concat('o', id) AS uid", "'p' AS page", "concat('h', id) AS parent", "concat('Use ', if(id % 3 = 0, 'x', 'y'), id) AS statement", "'b' AS body", "'accepted' AS status")
    got = L.reconcile(new, old)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    want = {"rehomed": n // 3, "reworded": n // 3, "added": n // 3, "orphaned": n // 3}
    assert {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()} == want


def test_overlaps_and_greedy_and_settle(spark):
    rng = random.Random(1)
    s = [(k, i, a := rng.randint(0, 40), a + rng.randint(0, 12)) for k in range(5) for i in range(12)]
    got = E.overlaps(spark.createDataFrame(s, "k int, i int, start int, end int"), "k", "i").collect()
    want = {(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in s for y in s if x[0] == y[0] and x[1] < y[1] and x[2] < y[3] and y[2] < x[3]}
    assert {tuple(r) for r in got if r.overlap > 0} == {w for w in want if w[3] > 0}
    pairs = spark.createDataFrame([("p", 1, 1, 2.0), ("p", 1, 2, 3.0), ("p", 2, 2, 3.0), ("p", 2, 1, 1.0), ("p", 3, 3, 0.0)], "k string, i int, j int, score double")
    assert {(r.i, r.j) for r in E.greedy(pairs, "k").collect()} == {(1, 2), (2, 1)}
    settle = lambda st, a, b: one(spark, E.settle_modality(F.col("s"), F.col("a"), F.col("b")), s=st, a=a, b=b)
    assert [settle("You must go", "SHOULD", "MUST"), settle("Go", "MUST", "SHOULD"), settle("Avoid it", "SHOULD", "SHOULD_NOT"), settle("x", "MAY", "MUST")] == ["MUST", "SHOULD", "SHOULD_NOT", ""]
    assert one(spark, E.settle_order(F.col("a"), F.col("b"), E.UNITS), a="phrase", b="block") == "block"


def test_greedy_by_distance_makes_no_pairs(spark):
    rng = random.Random(3)
    a = [(rng.randint(0, 2), rng.randint(0, 30), rng.randint(-20, 60) / 2) for _ in range(60)]  # names repeat
    b = [(rng.randint(0, 2), rng.randint(0, 40), rng.randint(0, 40) / 2) for _ in range(80)]
    want, taken = set(), {(k, s): set() for k in range(3) for s in "ij"}
    for k, score, i, j in sorted({(k, 3 - abs(x - y) // 4, i, j) for k, i, x in a for k2, j, y in b if k == k2}, key=lambda r: (r[0], -r[1], *r[2:])):
        if score > 0 and i not in taken[k, "i"] and j not in taken[k, "j"]:
            want.add((k, i, j, score)), taken[k, "i"].add(i), taken[k, "j"].add(j)
    sides = [spark.createDataFrame(rows, f"k int, {name} bigint, value double") for rows, name in ((a + [(9, 1, 1.0), (0, 2, None)], "i"), (b + [(8, 1, 1.0)], "j"))]
    assert {tuple(r) for r in E.greedy_near(*sides, "k", 4, 3).collect()} == want
    # 40,000 suppliers by 40,000 parts at one price are 1.6 billion pairs
    n = 40_000
    same = spark.range(n).selectExpr("0 AS k", "id AS i", "5D AS value")
    got = E.greedy_near(same, same.withColumnRenamed("i", "j"), "k", 500, 3)
    assert got.where("i = j AND score = 3").count() == n


def test_empty_denominators(spark):
    r = E.confusion(spark.createDataFrame([], "t boolean, s boolean"), F.col("t"), F.col("s")).first()
    assert (r.hits, r.precision, r.recall) == (0, None, None)


def test_readers_and_sinks(spark, tmp_path):
    rules = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "uid string, n int, note string")
    sinks.write_lines(rules, str(tmp_path / "l"), "uid")
    lines = [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert sorted(lines) == ['{"n":1,"note":"x","uid":"a"}', '{"n":2,"note":null,"uid":"b"}']
    assert readers.ledger(spark, str(tmp_path / "l"), "uid string, n int, note string").count() == 2
    (tmp_path / "m/s").mkdir(parents=True)
    (tmp_path / "m/s/p.md").write_text("# T")
    assert [tuple(r) for r in readers.markdown(spark, str(tmp_path / "m")).collect()] == [("s/p.md", "# T")]
    (tmp_path / "j.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.origin for r in readers.numbered_lines(spark, str(tmp_path / "j.jsonl")).orderBy("origin").collect()] == ["j.jsonl:1", "j.jsonl:3"]
    assert readers.globs('eligible:\n  - glob: "a/**"\n    requires_unit_review: true\nexcluded:\n  - glob: "b"\n') == [("a/**", True, True), ("b", False, False)]
    assert readers.settings("frozen: true\nreason: >\n  one\n  two\n") == {"frozen": "true", "reason": "one two"}
    xml = '<urlset xmlns="x"><url><loc>http://a</loc><lastmod>1</lastmod></url></urlset>'
    assert spark.createDataFrame([(xml,), ("no",)], "b string").select(F.explode(readers.sitemap("b", F.lit("http://a/sitemap.xml"))).alias("e")).select("e.*").first().loc == "http://a"


def test_replay_counts_once(spark, tmp_path):
    seen = []
    folder = tmp_path / "ops"
    folder.mkdir()
    for name, ids in (("1.json", [1, 2, 2]), ("2.json", [2, 3])):
        (folder / name).write_text("".join(json.dumps({"op_id": str(i)}) + "\n" for i in ids))
        ops = replay.read_ops(spark, str(folder), "op_id string")
        replay.replay(ops, str(tmp_path / "applied"), lambda df, n: seen.extend(r.op_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["1", "2", "3"]
