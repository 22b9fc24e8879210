import random

import numpy as np

from millrace.operators import evaluate as E
from millrace.operators import queues as Q


def test_settled_and_ready_pages(spark):
    spans = spark.createDataFrame([("h", "TA"), ("m", "MODELS"), ("x", None), ("both", "MODELS"), ("both", "TA")], "page string, by string")
    sweeps = spark.createDataFrame([("done", "complete", "MODELS"), ("open", "started", "MODELS"), ("mine", "complete", "TA")], "page string, status string, by string")
    settled = Q.settled_pages(spans, sweeps, ["MODELS", "JUDGE"])
    assert {r.page for r in settled.collect()} == {"h", "x", "both", "done"}
    pages = spark.createDataFrame([("h",), ("m",), ("n",), ("n",), ("o",)], "page string")
    drafted = spark.createDataFrame([("a", "m"), ("b", "m"), ("a", "n"), ("c", "n"), ("a", "h")], "drafter string, page string")
    assert {r.page: r.missing for r in Q.ready_pages(pages, drafted, settled, ["a", "b"]).collect()} == {"m": [], "n": ["b"], "o": ["a", "b"]}


def test_examples_left(spark):
    items, verdicts = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string"), spark.createDataFrame([("2",), ("2",)], "id string")
    assert [r.id for r in Q.example_queue(items, verdicts).collect()] == ["1"]


def test_what_the_other_drafter_declined(spark):
    singles = spark.createDataFrame([("p", "r1", "b", 0, 10), ("p", "r2", "b", 10, 20), ("q", "r1", "b", 0, 10)], "page string, rid string, block string, start int, end int")
    no = spark.createDataFrame([("p", 1, "b", 8, 12, "label", None), ("p", 0, "b", 5, 6, "advice", "soft"), ("p", 2, "c", 0, 99, "x", "y")], "page string, n int, block string, start int, end int, reason string, note string")
    assert {(r.page, r.rid): r.other_said for r in Q.declined(singles, no).collect()} == {("p", "r1"): "not a rule: advice soft", ("p", "r2"): "not a rule: label", ("q", "r1"): "nothing"}


def test_only_ready_matchers_are_adopted(spark):
    history = "history array<struct<`from`:string,`to`:string,by:string,at:string,note:string>>"
    rules = spark.createDataFrame([(u, "accepted", False, None, None, None, "awaiting review", None, None, 0.0, None) for u in "abc"], f"uid string, status string, detectable boolean, tier int, method string, matcher string, not_detectable_reason string, examples_pass boolean, density double, expected double, {history}")
    checks = spark.createDataFrame([("a", True, [], "regex", "{}", 1.23456, 2.0, "t.jsonl:1"), ("b", False, ["too dense", "no example"], "regex", "{}", 9.0, None, None), ("z", True, [], "regex", "{}", 0.0, None, None)], "uid string, ready boolean, blockers array<string>, method string, matcher string, density double, expected double, origin string")
    got, report = Q.adopted(rules, checks, spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("z",)], "uid string"), "TA", "now")
    assert {r.uid: r.outcome for r in report.collect()} == {"a": "adopted", "b": "blocked: too dense; no example", "c": "no proposal", "z": "no rule"}
    rows = {r.uid: r for r in got.collect()}
    a = rows["a"]
    assert (a.status, a.detectable, a.tier, a.method, a.examples_pass, a.density, a.expected, a.not_detectable_reason) == ("accepted", True, 0, "regex", True, 1.2346, 2.0, "")
    assert [tuple(h) for h in a.history] == [("accepted", "accepted", "TA", "now", "adopted Tier 0 matcher from t.jsonl:1")]
    assert rows["b"].detectable is False and rows["b"].history is None and len(rows) == 3


def test_likeness_on_other_pages(spark):
    rng = random.Random(9)
    words = [f"w{'x' * (i % 7)}{i}" for i in range(14)]
    draw = lambda: sorted(set(rng.choices(words, k=rng.randint(1, 9))))
    rules = [(f"r{i}", f"p{i % 4}", draw()) for i in range(40)]
    sentences = [(f"p{i % 5}", i, draw()) for i in range(120)]
    for threshold in (0.65, 0.5, 0.8):
        want = {}
        for uid, page, mine in rules:
            near = [(-len(set(mine) & set(w)) / len(set(mine) | set(w)), p, o) for p, o, w in sentences if p != page and len(mine) >= 4 and len(w) >= 4 and len(set(mine) & set(w)) / len(set(mine) | set(w)) >= threshold]
            if near:
                want[uid] = min(near)[1:]
        got = E.stated_elsewhere(spark.createDataFrame(rules, "uid string, page string, tokens array<string>"), spark.createDataFrame(sentences, "page string, ord int, tokens array<string>"), threshold)
        assert {r.uid: (r.other, r.ord) for r in got.collect()} == want
    assert want


def test_sentences_said_often_are_one_set(spark):
    """500 rules and 2,000 sentences of the same words would be a million pairs; places are kept for two pages only, and long sets still meet."""
    common, long = [f"word{i}" for i in range(6)], [f"far{i}" for i in range(90)]
    sentences = [(f"p{i:04}", 0, common[::-1] if i % 2 else common) for i in range(2000)] + [("q1", 3, long), ("q2", 1, [*long[:80], "x", "y"]), ("q0", 7, [*long[:60]])]
    rules = [(f"r{i}", f"p{i:04}", common) for i in range(500)] + [("far", "q1", long), ("near", "q9", long[:59])]
    schemas = "uid string, page string, tokens array<string>", "page string, ord int, tokens array<string>"
    got = {r.uid: tuple(r) for r in E.stated_elsewhere(*map(spark.createDataFrame, (rules, sentences), schemas)).collect()}
    assert got["r0"] == ("r0", "p0000", "p0001", 0, 6, 6) and all(got[f"r{i}"][2:4] == ("p0000", 0) for i in range(1, 500))
    assert got["far"] == ("far", "q1", "q2", 1, 80, 92) and got["near"] == ("near", "q9", "q0", 7, 59, 60) and len(got) == 502
    assert E._rare_words(spark.range(100).selectExpr("7L AS key", "array(1L, 2L, 3L, 4L) AS words"), np.zeros(E._COUNTED, "i8"), 0.65).count() <= 4 * 2
