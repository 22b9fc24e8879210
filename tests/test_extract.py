import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import extract as R
from millrace.operators import golden as G
from millrace.operators import ledger as L
from millrace.operators import structure as B
from millrace.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_admission(spark):
    rows = [(1, "Use it", "rule", "imperative", None), (2, "Use  it", "rule", "imperative", None), (2, "Hyphens", "section", "", True), (2, "Dashes", "section", "", None), (3, "Write this", "example", "", True)]
    got = R.admitted(frame(spark, rows, "level int, title string, kind string, form string, paired boolean"))
    assert sorted((r.statement, r.kind, r.form) for r in got.collect()) == [("Hyphens", "rule", "exemplified"), ("Use it", "rule", "imperative")]


def test_seeded_examples(spark):
    df = frame(spark, [({"write this": ["a"], "correct": ["b"], "not this": ["c"], "example": ["d"], R.GOLD[0]: ["e"], R.GOLD[1]: ["f"]},), ({},)], "x map<string,array<string>>")
    got = [r.s for r in df.select(R.seeded(F.col("x")).alias("s")).collect()]
    assert (got[0].compliant, got[0].violating) == (["b", "a", "e"], ["c", "f"]) and (got[1].compliant, got[1].violating) == ([], [])


def test_rebuild_revives_and_leaves_rejected_alone(spark):
    cand = [("u1", "p", ["A"], "Use it", "imperative", "body", 3, "golden", [], {"correct": ["x"]})]
    cands = frame(spark, cand, "uid string, page string, path array<string>, statement string, form string, body string, line int, origin string, preconditions array<string>, examples map<string,array<string>>")
    urls, hashes = frame(spark, [("p", "u")], "page string, url string"), frame(spark, [("p", "h")], "page string, sha256 string")
    old = R.as_rules(cands, urls, hashes, "t0")
    retired = R.moved(old, "orphaned", "t0", F.lit("gone"))
    none = frame(spark, [], "page string")
    back = R.rebuilt(retired, frame(spark, [("added", None, "u1")], "outcome string, old_uid string, cand_uid string"), cands, none, urls, hashes, "t1").collect()
    assert [(r.uid, r.status, [h.to for h in r.history]) for r in back] == [("u1", "proposed", ["orphaned", "proposed"])]
    lost = frame(spark, [("orphaned", "u1", None)], "outcome string, old_uid string, cand_uid string")
    judged = old.withColumn("status", F.lit("rejected"))
    swept = frame(spark, [("p",)], "page string")
    assert [r.status for r in R.rebuilt(judged, lost, cands.limit(0), swept, urls, hashes, "t1").collect()] == ["rejected"]
    assert [(r.status, r.history[0].note) for r in R.rebuilt(judged, lost, cands.limit(0), none, urls, hashes, "t1").collect()] == [("orphaned", "source heading no longer present in corpus")]
    assert [(r.method, r.compliant, r.severity if "severity" in r else None) for r in old.collect()] == [("human_span", ["x"], None)]


def test_golden_refusals(spark):
    rows = [("r1", "p", "rule", None, None, "u"), ("r2", "p", "rule", None, None, "u"), ("e1", "p", "compliant", "r1", "g", None), ("e2", "p", "violating", "r1", "g", None), ("e3", "p", "compliant", "zz", None, None)]
    bad = R.golden_refusals(frame(spark, rows, "span_id string, page string, kind string, of string, grp string, uid string"))
    assert sorted((r.span_id, r.reason) for r in bad.collect()) == [("e1", "a group of examples of both kinds"), ("e2", "a group of examples of both kinds"), ("e3", "its rule is missing"), ("r1", "another span makes the same rule"), ("r2", "another span makes the same rule")]
    with pytest.raises(readers.SourceError, match="its rule is missing"):
        readers.checked(bad, bad.where("span_id = 'e3'"), "golden spans")


def test_labels_and_polarity(spark):
    rows = [("p", "1", 1, "heading", "Write this"), ("p", "2", 2, "para", "good"), ("p", "3", 3, "para", "Not this"), ("p", "4", 4, "para", "bad"), ("p", "5", 5, "heading", "Else"), ("p", "6", 6, "para", "none"), ("p", "7", 7, "heading", "Example"), ("p", "8", 8, "li", "shown")]
    blocks = G.nearest_labels(frame(spark, rows, "page string, block_id string, ord int, kind string, plain string"))
    assert [r.label for r in blocks.orderBy("ord").collect()] == ["write this", "write this", "not this", "not this", "", "", "example", "example"]
    ex = frame(spark, [("a", "p", "2", "violating"), ("b", "p", "4", "compliant"), ("c", "p", "4", "violating"), ("d", "p", "8", "violating"), ("e", "p", "6", "violating")], "span_id string, page string, block_id string, kind string")
    assert sorted((r.span_id, r.level) for r in G.example_polarity(ex, blocks).collect()) == [("a", "fix"), ("b", "fix"), ("d", "check")]
    shown = blocks.withColumn("example", F.col("kind") != "heading").withColumn("path", F.array(F.lit("A")))
    assert [(r.page, r.blocks) for r in G.unused_labelled(shown, ex.where("block_id = '2'")).collect()] == [("p", 2)]


def test_queues_and_totals(spark):
    m = frame(spark, [("a", None, ["p", "q"]), ("a", True, ["r"]), ("b", False, ["p"])], "drafter string, collected boolean, requests array<string>")
    assert sorted(map(tuple, E.in_flight(m).collect())) == [("a", "p"), ("a", "q"), ("b", "p")]
    f = frame(spark, [("p", "fix"), ("p", "look"), ("q", "fix")], "page string, level string")
    assert sorted(map(tuple, E.level_counts(f).collect())) == [("p", 1, 0, 1), ("q", 1, 0, 0)]
    empty = E.recall_totals(E.span_recall(frame(spark, [], "page string, statement string, whole boolean"), frame(spark, [], "page string, statement string"), frame(spark, [], "page string"))).first()
    assert (empty.pages_swept, empty.hits, empty.precision, empty.recall_overall) == (0, 0, None, None)
    assert E.remaining_words(frame(spark, [], "page string, words int, eligible boolean"), frame(spark, [], "page string")).first().words == 0


def test_unmarked_directives(spark):
    s = frame(spark, [("p", "b", ["A", "B"], 0, 5, "Use it."), ("p", "b", ["A", "B"], 6, 9, "Say so."), ("p", "c", [], 0, 4, "Ask."), ("p", "d", ["A"], 0, 4, "Go on.")], "page string, block_id string, path array<string>, start int, `end` int, text string")
    spans = frame(spark, [("p", "b", 8, 20)], "page string, block_id string, start int, `end` int")
    rules = frame(spark, [("p", "wide", ["A"], "x", "", [], True), ("p", "deep", ["A", "B"], "y", "we say Ask now", [], True), ("p", "none", ["A", "B"], "z", "", [], False)], "page string, uid string, path array<string>, statement string, specification string, preconditions array<string>, heading boolean")
    assert sorted((r.text, r.owner) for r in G.unmarked_directives(s, spans, rules).collect()) == [("Go on.", "wide"), ("Use it.", "deep")]


def test_offsets_across_ranges(spark):
    rows = [("p", i, "x" * (i % 5)) for i in range(40)] + [("q", 7, "a"), ("q", 99, "bc")]
    got = B.joined_offsets(frame(spark, rows, "page string, ord int, plain string"), span=8).collect()
    at = {}
    for p, i, t in rows:
        start = at.get(p, 0)
        assert [(r.start, r.end) for r in got if (r.page, r.ord) == (p, i)] == [(start, start + len(t))]
        at[p] = start + len(t) + 2


def test_sources_refuse(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"op": "span", "op_id": "1"}\n{"op_id": "2"}\n')
    with pytest.raises(readers.SourceError, match="without op"):
        readers.operations(spark, str(tmp_path / "o.jsonl"))
    (tmp_path / "r.jsonl").write_text('{"uid": "1"}\n{"uid": "1"}\n')
    with pytest.raises(readers.SourceError, match="repeated"):
        readers.ledger(spark, str(tmp_path / "r.jsonl"), "uid string")
    assert readers.keyed_map(spark, str(tmp_path / "none.json"), "pages").count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("café")
    (tmp_path / "m" / "b.md").write_text("x")
    known = frame(spark, [("a.md", "2020")], "path string, lastmod string")
    got = readers.scan_disk(spark, str(tmp_path / "m"), known)
    assert sorted((r.path, r.lastmod) for r in got.collect()) == [("a.md", "2020"), ("b.md", None)]
    pages = B.normalised_pages(frame(spark, [("a.md", "café")], "path string, raw string"))
    assert pages.first().sha256 == got.where("path = 'a.md'").first().sha256
    sinks.write_lock(got, str(tmp_path / "lock"))
    assert [r.value[:40] for r in spark.read.text(str(tmp_path / "lock")).collect()][0].startswith('{"lastmod":"2020","path":"a.md"')
    assert [r.text for r in readers.plain_text(spark, str(tmp_path / "m" / "b.md")).collect()] == ["x"]


def test_small_readers_and_rules(spark, tmp_path):
    drafts = frame(spark, [("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "page string, at int, body string")
    assert sorted((r.page, r.body) for r in readers.latest(drafts, "page", "at").collect()) == [("p", "b"), ("q", "c")]
    markers = frame(spark, [("p", "1", "x"), ("p", "2", "y")], "page_path string, at string, note string")
    assert [r.note for r in readers.last_sweep(markers).collect()] == ["y"]
    cache = frame(spark, [("p", "1"), ("q", "2")], "page_path string, input_sha256 string")
    pages = frame(spark, [("p", "1"), ("q", "9"), ("r", "3")], "page_path string, input_sha256 string")
    assert sorted((r.page_path, r.state) for r in readers.cache_state(pages, cache).collect()) == [("p", "cached"), ("q", "stale"), ("r", "new")]
    assert [r.page_path for r in readers.valid_verdicts(cache, pages).collect()] == ["p"]
    assert readers.word_list(["# c", "Use", " use ", "", "Ask"]) == ("use", "ask")
    rules = frame(spark, [("a", "accepted", True, "sentence", "regex"), ("b", "accepted", True, "artifact", "regex"), ("c", "proposed", True, "sentence", "regex"), ("d", "amended", True, "sentence", "none")], "uid string, status string, detectable boolean, unit string, method string")
    assert [r.uid for r in L.loadable(rules).collect()] == ["a"]
    found = frame(spark, [("p", ["A", "Correct"], "Correct"), ("p", ["A", "Not this"], "Not this"), ("p", ["B", "Correct"], "Correct")], "page string, path array<string>, title string")
    assert [r.parent for r in B.polarised(found).collect()] == [["A"]]
    below = frame(spark, [(["A", "Incorrect"],), (["A"],)], "path array<string>")
    assert [r.path for r in B.without_negative(below).collect()] == [["A"]]
    digests = B.digest_rows(frame(spark, [("p", 2, "b"), ("p", 1, "a"), ("q", 1, "a")], "page string, ord int, t string"), "page", "ord", "t").collect()
    assert {r.page: r.n for r in digests} == {"p": 2, "q": 1} and len({r.digest for r in digests}) == 2
    sinks.append(rules.select("uid", F.lit(1).alias("_private")), str(tmp_path / "log"), "here")
    assert sorted(spark.read.json(str(tmp_path / "log")).columns) == ["applied_from", "uid"]
    assert not sinks.write_pages(rules, str(tmp_path / "pages"), frozen=True) and sinks.write_pages(rules, str(tmp_path / "pages"), frozen=False)
    sinks.write_cache(frame(spark, [("v1", "m", "x")], "prompt_version string, drafter string, body string"), str(tmp_path / "cache"))
    assert spark.read.json(str(tmp_path / "cache")).first().drafter == "m"
    card = sinks.cards(frame(spark, [("p", 2), ("p", 1)], "page string, n int"), "page").first()
    assert card.json == '{"page":"p","items":[{"n":1},{"n":2}]}'
