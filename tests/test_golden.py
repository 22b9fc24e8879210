from pyspark.sql import functions as F

from millrace.operators import golden as G
from millrace.plans import catalogue


def test_resolve(spark):
    blocks = spark.createDataFrame([("p", "b1", ["A"], "one two one"), ("p", "b2", ["B"], "three one"), ("p", "b3", ["B"], "four")], "page string, block_id string, path array<string>, text string")
    spans = [("exact", "p", "b1", ["A"], 4, "two", "", ""), ("moved", "p", "gone", ["B"], 0, "three", "", " one"), ("page", "p", "gone", ["Z"], 0, "four", "", ""), ("twice", "p", "gone", ["Z"], 0, "one", "", ""), ("context", "p", "b1", ["A"], 9, "one", "two ", ""), ("none", "p", "b3", ["B"], 0, "five", "", "")]
    got = G.resolve(spark.createDataFrame(spans, "span_id string, page string, block_id string, path array<string>, start int, quote string, prefix string, suffix string"), blocks)
    assert {r.span_id: (r.block_id, r.start, r.how) for r in got.collect()} == {
        "exact": ("b1", 4, "exact"), "moved": ("b2", 0, "context"), "page": ("b3", 0, "page"), "twice": (None, None, "lost"), "context": ("b1", 8, "context"), "none": (None, None, "lost"),
    }


def test_places():
    assert G.places(["aaa", None, "é" * 40, "xaa"], {"aa", "é" * 39}) == {"aa": [(0, 0), (0, 1), (3, 1)], "é" * 39: [(2, 0), (2, 1)]}


def test_anchor_resolution_sees_whole_documents(spark, tmp_path):
    lines = [f"{'the same first thirty characters of a line'} {i}" for i in range(9)] + ["again", "again"]
    spark.createDataFrame([(1, "\n".join(lines), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.span_id: (r.block_id, r.how) for r in catalogue.queries()["anchor_resolution"](spark, str(tmp_path)).collect()}
    assert got == {f"1:{i}": (str(i + 1), "context") for i in range(9)} | {"1:9": (None, "lost"), "1:10": ("10", "exact")}


def test_folded(spark):
    ops = [("1", "t1", "span", "r", None, "a"), ("2", "t2", "span", "r", None, "b"), ("3", "t1", "span", "c", "r", "x"), ("4", "t1", "span", "d", "q", "x"), ("5", "t1", "span", "q", None, "q"), ("6", "t3", "span_del", "q", None, None)]
    got = G.folded(spark.createDataFrame(ops, "op_id string, at string, op string, span_id string, of string, body string"))
    assert sorted((r.span_id, r.body) for r in got.collect()) == [("c", "x"), ("r", "b")]


def test_lint_and_sweeps(spark):
    rules = [
        ("a", "accepted", "Don't use it", "", "unambiguous", "MUST", " ", "absence", []), ("b", "accepted", "Use 5 words", "", "unambiguous", "MAY", "", "presence", ["use 5  words", "at most 7"]),
        ("c", "amended", "Use 5 words", "or 7", "unambiguous", "MUST", "v", "presence", ["at most 7", "Use 5  words"]), ("d", "accepted", "Words are short", "", "ambiguous_resolvable", "MUST", "v", "", ["over 9"]),
        ("e", "rejected", "Never", "", "unambiguous", "MUST", "", "", []), ("f", "accepted", "Avoid it", "", "unambiguous", "MUST", "v", "presence", []),
    ]
    got = G.lint(spark.createDataFrame(rules, "uid string, status string, statement string, body string, clarity string, modality string, violation_condition string, direction string, preconditions array<string>"))
    assert sorted((r.uid, r.level, r.finding) for r in got.collect()) == [
        ("a", "check", "direction-looks-inverted"), ("a", "fix", "no-violation-condition"), ("b", "check", "chosen-threshold"), ("b", "check", "permission-as-rule"),
        ("c", "check", "direction-looks-inverted"), ("c", "check", "precondition-restates-rule"), ("d", "fix", "no-direction"),
    ]
    marked = spark.createDataFrame([("p",), ("q",), ("r",)], "page string")
    assert [r.page for r in G.unswept(marked, spark.createDataFrame([("p", "complete"), ("q", "in_progress")], "page string, status string")).orderBy("page").collect()] == ["q", "r"]
    c = spark.createDataFrame([("p", "1", "accepted", False), ("p", "2", "proposed", True), ("p", "3", "proposed", False), ("q", "4", "accepted", False), ("p", "5", "amended", False)], "page string, uid string, status string, paired boolean")
    spans = spark.createDataFrame([("p", "1")], "page string, seed_uid string")
    dropped, sweeps = spark.createDataFrame([("p", "2")], "page string, uid string"), spark.createDataFrame([("p", "complete"), ("q", "in_progress")], "page string, status string")
    assert [tuple(r) for r in G.sweep_errors(dropped, c, spans, sweeps).collect()] == [("p", "5")]


def test_examples_and_proposals(spark):
    rows = [("m", "uses utilise", True), ("m", "use it", False), ("m", "fine\nnot utilise", False), ("m", "other", True)]
    ex = spark.createDataFrame(rows, "rule_uid string, example string, violating boolean")
    got = G.check_examples([("m", "literal_set", {"terms": ["utilise"]})], ex).first()
    assert (got.missed, got.false_alarms) == (["other"], ["fine\nnot utilise"])
    checks = spark.createDataFrame([("m", ["x"], [], 1, 0, 1.0), ("n", [], [], 1, 1, 1.0)], "rule_uid string, missed array<string>, false_alarms array<string>, n_compliant int, n_violating int, expected double")
    out = {r.rule_uid: (r.ready, r.blockers) for r in G.proposals(checks, spark.createDataFrame([("n", 1.0), ("m", 2.0)], "rule_uid string, density double")).collect()}
    assert out["n"] == (True, []) and out["m"] == (False, ["no violating example", "misses a violating example", "denser than expected"])


def test_consensus(spark):
    kind = "page string, i int, section string, start int, `end` int, words array<string>, examples array<string>"
    a = spark.createDataFrame([("p", 0, "s", 0, 5, ["x"], []), ("p", 1, "s", 10, 12, ["a", "b"], []), ("p", 2, "t", 20, 22, [], ["e"])], kind)
    b = spark.createDataFrame([("p", 0, "s", 3, 9, ["y"], []), ("p", 1, "s", 50, 52, ["a", "b", "c"], []), ("p", 2, "u", 60, 61, [], ["e"]), ("p", 3, "u", 70, 71, [], [])], kind)
    from millrace.operators import evaluate as E

    pairs = spark.createDataFrame([("p", 0, 0, 5.0), ("p", 1, 1, 2.667), ("p", 1, 0, 2.0), ("p", 2, 2, 1.51), ("p", 2, 3, 0.0)], "page string, i int, j int, score double")
    matched = E.greedy(pairs, "page")
    assert {(r.i, r.j): r.score for r in matched.collect()} == {(0, 0): 5.0, (1, 1): 2.667, (2, 2): 1.51}
    assert {(r.i, r.j, r.outcome) for r in G.plan(matched, a, b).collect()} == {(0, 0, "agreed"), (1, 1, "agreed"), (2, 2, "agreed"), (None, 3, "single-b")}
    votes = spark.createDataFrame([("p", "1", "good", "a", None), ("p", "1", "good", "b", None), ("p", "2", "good", "a", "bad"), ("p", "2", "bad", "b", "bad"), ("p", "3", "good", "a", None)], "page string, extent string, kind string, drafter string, label string")
    assert {r.extent: (r.kind, r.how) for r in G.merged_examples(votes).collect()} == {"1": ("good", "agreed"), "2": ("bad", "label"), "3": (None, "item")}
    rules, items = spark.createDataFrame([("p", "r"), ("q", "s")], "page string, uid string"), spark.createDataFrame([("i1", "p"), ("i2", "q")], "item_id string, page string")
    assert [r.uid for r in G.exportable(rules, items, items.where(F.col("item_id") == "i2")).collect()] == ["s"]
