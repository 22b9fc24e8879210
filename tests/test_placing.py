import random
import re

from conftest import SMALL
from pyspark.sql import functions as F

from millrace.operators import golden as G
from millrace.operators import placing as P


def canonical(text):
    return re.sub(r"\s+", " ", text.translate(str.maketrans("’‘“”‑‐", "''\"\"--"))).strip()


def plain_hit(block, needle):
    want = canonical(needle)
    out, index = "", []
    for i, c in enumerate(block):
        if c.isspace():
            if not out.endswith(" ") or not block[i - 1].isspace():
                out, index = out + " ", [*index, i]
        else:
            out, index = out + c.translate(str.maketrans("’‘“”‑‐", "''\"\"--")), [*index, i]
    at = out.find(want) if want else -1
    return None if at < 0 else (index[at], index[at + len(want) - 1] + 1)


def test_hits_are_raw_places(spark):
    rng = random.Random(5)
    bits = ["a", "b", "ab", " ", "  ", " \n", " ", "’", "'", "“", "\"", "‑", "-", "😀", ".", "\\E", "(", "é"]
    rows = [("".join(rng.choices(bits, k=rng.randint(0, 14))), "".join(rng.choices(bits, k=rng.randint(0, 4)))) for _ in range(600)] + [("say  “don’t\n do”", "\"don't do\""), ("x", ""), (None, "x"), ("x", None)]
    got = spark.createDataFrame(rows, "b string, n string").select("b", "n", P.canonical_hit(F.col("b"), F.col("n")).alias("h")).collect()
    found = 0
    for r in got:
        want = None if r.b is None or r.n is None else plain_hit(r.b, r.n)
        assert (r.h and (r.h.start, r.h.end)) == want, (r.b, r.n)
        found += want is not None
        if r.h:
            assert canonical(r.b[r.h.start : r.h.end]) == canonical(r.n)
    assert found > 60


def test_every_line_is_found_or_none(spark):
    blocks = spark.createDataFrame([("p", "b0", 0, ["A"], "Write in short plain words."), ("p", "b1", 1, ["A", "B"], "Write in  short plain words and more"), ("p", "b2", 2, ["C"], "Theoretical Studies is a journal"), ("p", "b3", 3, ["C"], "")], "page string, block string, ord int, path array<string>, plain string")
    strings = [
        ("p", 1, "short plain words", None), ("p", 2, "short plain words", ["A", "B"]), ("p", 3, "*Theoretical Studies* is\n\nin short", None), ("p", 4, "in short\nnot there at all", None),
        ("p", 5, "", None), ("p", 6, None, None), ("q", 7, "in short", None), ("p", 8, "words", ["C"]), ("p", 9, "- short plain", ["A"]),
    ]
    got = {r.sid: [(x.line, x.block, x.start, x.end) for x in r.parts] for r in P.located(spark.createDataFrame(strings, "page string, sid int, text string, section array<string>"), blocks).collect()}
    assert got == {1: [(0, "b0", 9, 26)], 2: [(0, "b1", 10, 27)], 3: [(0, "b2", 0, 22), (2, "b0", 6, 14)], 4: [], 5: [], 6: [], 7: [], 8: [(0, "b0", 21, 26)], 9: [(0, "b0", 9, 20)]}


def test_pages_are_searched_whole(spark):
    """Short and long pages, with and without the words' index, against the expression on every block."""
    rng = random.Random(7)
    say = ["on", "the", "“quoted”", "well‑kept", "word", "end.", "(a", "b)", "sentence", "  two", "\u00a0"]
    for size in (6, 900):
        plain = [" ".join(rng.choices(say, k=rng.randint(0, 14))) for _ in range(size)]
        text = P.PageText([(n, None, t) for n, t in enumerate(plain)])
        assert (len(text.whole) > P._LONG) == (size == 900)
        for _ in range(60):
            needle = " ".join(rng.choices(say, k=rng.randint(1, 5)))
            hits = [(n, *h) for n, t in enumerate(plain) if (h := plain_hit(t, needle))]
            assert text.find(needle, None) == (hits[0] if hits else None)
    from millrace.plans import placing

    assert "Exchange" not in placing.located_lines(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_entries_are_claimed_once(spark):
    strings = [("r", 1, "a b"), ("r", 2, "a b"), ("r", 3, "a  b"), ("r", 4, "don’t"), ("r", 5, "x"), ("r", 6, "don't"), ("s", 1, "a b")]
    entries = [("r", 1, "a b"), ("r", 2, "a b"), ("r", 3, "don't"), ("r", 4, "y")]
    got = P.claimed(spark.createDataFrame(strings, "rule string, n int, text string"), spark.createDataFrame(entries, "rule string, e int, text string"), ["rule"]).collect()
    assert {(r.rule, r.n, r.e, r.how) for r in got} == {("r", 1, 1, "exact"), ("r", 2, 2, "exact"), ("r", 3, 1, "shared"), ("r", 4, 3, "shared"), ("r", 5, None, "none"), ("r", 6, 3, "exact"), ("s", 1, None, "none"), ("r", None, 4, "unclaimed")}
    more = P.claimed(spark.createDataFrame(strings[:4], "rule string, n int, text string"), spark.createDataFrame([*entries, ("r", 9, "a\tb")], "rule string, e int, text string"), ["rule"]).collect()
    assert {(r.n, r.e, r.how) for r in more} == {(1, 1, "exact"), (2, 2, "exact"), (3, 9, "canonical"), (4, 3, "canonical"), (None, 4, "unclaimed")}
    assert P.claimed(spark.createDataFrame([], "rule string, n int, text string"), spark.createDataFrame([], "rule string, e int, text string"), ["rule"]).count() == 0


def test_examples_with_their_places(spark):
    blocks = spark.createDataFrame([("p", "b0", 0, ["A"], "Only on the page."), ("p", "b1", 1, ["A"], "From a span")], "page string, block string, ord int, path array<string>, plain string")
    strings = spark.createDataFrame([("p", "r", "good", 0, "From a span", ["A"]), ("p", "r", "good", 1, "on the page", ["A"]), ("p", "r", "bad", 0, "nowhere", ["A"])], "page string, rule string, kind string, n int, text string, section array<string>")
    spans = spark.createDataFrame([("r", "good", 0, "From a span", [("b1", 0, 11)]), ("r", "bad", 0, "never listed", [("b0", 0, 4)])], "rule string, kind string, e int, text string, parts array<struct<block:string,start:int,`end`:int>>")
    got = {(r.kind, r.text): (r.n, r.how, [tuple(x) for x in r.parts]) for r in P.placed_examples(strings, spans, blocks).collect()}
    assert got == {("good", "From a span"): (0, "span", [("b1", 0, 11)]), ("good", "on the page"): (1, "text", [("b0", 5, 16)]), ("bad", "nowhere"): (0, "none", []), ("bad", "never listed"): (None, "span_only", [("b0", 0, 4)])}


def test_pointers_fold_typography(spark):
    pointers = spark.createDataFrame([("p", 0, "b", "don't do"), ("p", 1, "b", "a-b"), ("p", 2, "b", "“a")], "page string, ord int, block_id string, quote string")
    got = {r.ord: (r.start, r.refused) for r in G.resolved_pointers(pointers, spark.createDataFrame([("p", "b", "We don’t do a–b and a—b")], "page string, block_id string, plain string"), spark.createDataFrame([("p", "T")], "page string, title string")).collect()}
    assert got == {0: (3, None), 1: (None, "quote not unique"), 2: (None, "quote not found")}


def test_orphans_stay_and_are_told(spark):
    ops = spark.createDataFrame([("1", "1", "span", "a", None), ("2", "2", "span", "kid", "a"), ("3", "3", "span", "lost", "never"), ("4", "4", "span", "gone", None), ("5", "5", "span", "kid2", "gone"), ("6", "6", "span_del", "gone", None)], "op_id string, at string, op string, span_id string, of string")
    spans = G.folded(ops)
    assert {r.span_id for r in spans.collect()} == {"a", "kid", "lost"}
    assert [tuple(r) for r in G.orphans(spans).collect()] == [("lost", "never")]
