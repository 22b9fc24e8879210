import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import scoring as C
from millrace.plans import scores as plans

RULE = "page string, i long, block string, start int, end int, quote string, tags map<string,string>"
EXAMPLE = "page string, i long, block string, start int, end int, quote string, kind string, ord int"
BLOCKS = "page string, block string, kind string, path array<string>"


def words(text):
    return {w for w in re.findall(r"[a-z]+", text.lower()) if len(w) > 2}


def plain_score(blocks, a, b):
    """a, b: (block, start, end, quote, examples)."""
    if a[0] == b[0] and min(a[2], b[2]) > max(a[1], b[1]) and a[0] in blocks:
        return 3.0 + min(a[2], b[2]) - max(a[1], b[1])
    if a[0] not in blocks or b[0] not in blocks:
        return 0.0
    wa, wb = words(a[3]), words(b[3])
    like = len(wa & wb) / len(wa | wb) if wa | wb else 0.0
    for head, prose in ((blocks[a[0]], blocks[b[0]]), (blocks[b[0]], blocks[a[0]])):
        if head[0] == "heading" and prose[0] != "heading" and (prose[1] == head[1] or (prose[1][:-1] == head[1] and prose[1] and prose[1][-1].strip().lower() in C.LABELS)):
            return 2 + like
    if common := len(a[4] & b[4]):
        return 1.5 + min(common, 49) / 100
    n = min(len(blocks[a[0]][1]), len(blocks[b[0]][1]))
    return like if n and blocks[a[0]][1][:n] == blocks[b[0]][1][:n] and like >= 0.5 else 0.0


def plain_greedy(scored):
    left, right, out = set(), set(), set()
    for score, i, j in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if score > 0 and i not in left and j not in right:
            left.add(i), right.add(j), out.add((i, j, round(score, 9)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    say = "use the short word keep lists flat write dates in full avoid latin terms ask one thing".split()
    paths = [[], ["A"], ["A", "B"], ["A", "B", "Not this"], ["A", " Example "], ["C"], ["C", "Other"]]
    blocks, rules, examples = [], {0: [], 1: []}, {0: [], 1: []}
    by_page = {}
    for page in ("p", "q", "r"):
        known = {f"b{k}": (rng.choice(["heading", "para", "li"]), rng.choice(paths)) for k in range(12)}
        by_page[page] = known
        blocks += [(page, b, kind, path) for b, (kind, path) in known.items()]
        for side in (0, 1):
            for i in range(14):
                start = rng.randint(0, 30)
                rules[side].append((page, i, rng.choice([*known, "gone"]), start, start + rng.randint(0, 25), " ".join(rng.choices(say, k=rng.randint(0, 6))), {}))
                examples[side] += [(page, i, f"e{rng.randint(0, 4)}", 0, 5, "x", "compliant", n) for n in range(rng.choice([0, 0, 1, 3]))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    b = frame(blocks, BLOCKS)
    got = C.alike(*[C.placed(frame(rules[s], RULE), b) for s in (0, 1)], *[frame(examples[s], EXAMPLE) for s in (0, 1)], ["page"])
    want = {}
    for page, known in by_page.items():
        kids = [{(r[0], r[1]): {e[2:5] for e in examples[s] if e[:2] == r[:2]} for r in rules[s]} for s in (0, 1)]
        for x in rules[0]:
            for y in rules[1]:
                if x[0] == y[0] == page and (score := plain_score(known, (*x[2:6], kids[0][x[:2]]), (*y[2:6], kids[1][y[:2]]))):
                    want[page, x[1], y[1]] = round(score, 9)
    assert {(r.page, r.i, r.j): round(r.score, 9) for r in got.collect()} == want
    taken = {(r.page, r.i, r.j, round(r.score, 9)) for r in E.greedy(got, "page").collect()}
    assert taken == {(p, *t) for p in by_page for t in plain_greedy([(s, i, j) for (q, i, j), s in want.items() if q == p])}


@pytest.fixture
def world(spark):
    """A page marked blind and a page marked with a draft on screen."""
    blocks = [("blind", "h", "heading", ["P"]), ("blind", "reflexive", "para", ["P"]), ("blind", "case", "para", ["P"]), ("blind", "relative", "heading", ["P", "R"]), ("blind", "good", "li", ["P", "Correct"]), ("blind", "bad", "li", ["P", "Incorrect"])]
    blocks += [("seeded", "web", "heading", ["S", "W"]), ("seeded", "short", "heading", ["S", "C"])]
    text = {"reflexive": "Don’t use a reflexive pronoun if nothing reflects", "case": "Use the correct case when writing pronouns.", "relative": "Relative pronouns show", "good": "I emailed myself.", "bad": "The manager emailed myself.", "web": "Don’t end web addresses", "short": "No stops in contractions"}
    tags = {"direction": "presence", "modality": "SHOULD_NOT"}

    def rule(page, i, block, *more):
        return (page, i, block, 0, len(text[block]), text[block], tags, *more)

    def example(page, i, block, kind, n):
        return (page, i, block, 0, len(text[block]), text[block], kind, n)

    frame = spark.createDataFrame
    golden = frame([rule("blind", 0, "reflexive", False), rule("blind", 1, "case", False), rule("seeded", 0, "web", True), rule("seeded", 1, "short", False)], RULE + ", seeded boolean")
    mine = frame([example("blind", 0, "good", "compliant", 0), example("blind", 0, "bad", "violating", 1)], EXAMPLE)
    drafts = frame([("d", *rule("blind", 0, "reflexive")), ("d", *rule("blind", 1, "relative")), ("d", *rule("seeded", 0, "web"))], "drafter string, " + RULE)
    theirs = frame([("d", *example("blind", 0, "good", "compliant", 0)), ("d", *example("blind", 0, "bad", "compliant", 1))], "drafter string, " + EXAMPLE)
    drafted = frame([("d", "blind", 3), ("d", "seeded", 0), ("d", "unmarked", 9)], "drafter string, page string, refused long")
    walk = frame([("blind", "h"), ("seeded", "web"), ("seeded", "web")], "page string, block string")
    directives = frame([("blind", "reflexive", 0, 20), ("blind", "case", 0, 9), ("blind", "relative", 0, 3)], "page string, block string, start int, end int")

    def score(swept):
        pages = frame([("blind", True, swept), ("seeded", False, False)], "page string, blind boolean, swept boolean")
        return C.Scored(golden, mine, drafted, drafts, theirs, frame(blocks, BLOCKS), pages, walk, directives)

    return score


def test_a_blind_page_measures_recall_and_polarity(world):
    scored = world(False)
    rows = {r.page: r for r in scored.pages().collect()}
    assert set(rows) == {"blind", "seeded"}
    r = rows["blind"]
    assert (r.golden, r.drafted, r.matched, r.exact_extent, r.refused) == (2, 2, 1, 1, 3)
    assert (r.examples_golden, r.examples_found, r.conflicts) == (2, 2, 1)
    assert {(x.side, x.quote[:12]) for x in scored.unmatched().where("page = 'blind'").collect()} == {("missed", "Use the corr"), ("extra", "Relative pro")}
    assert [(x.quote, x.human, x.draft) for x in scored.examples().where("human <> draft").collect()] == [("The manager emailed myself.", "violating", "compliant")]
    assert {(x.tag, x.agree, x.compared) for x in scored.tags().where("page = 'blind'").collect()} == {("direction", 1, 1), ("modality", 1, 1)}


def test_precision_waits_for_the_sweep(world):
    for swept, want in ((False, None), (True, 0.5)):
        got = {(r.drafter, r.stratum): r for r in C.totals(world(swept).pages()).collect()}
        assert set(got) == {(d, s) for d in "d*" for s in ("blind", "seeded")}
        assert got["d", "blind"].precision == want and got["*", "blind"].recall == 0.5


def test_a_seeded_page_reports_acceptance_and_never_quality(world):
    scored = world(False)
    r = next(r for r in scored.pages().collect() if r.page == "seeded")
    assert (r.accepted, r.added, r.matched) == (1, 1, 1)
    t = next(r for r in C.totals(scored.pages()).collect() if r.stratum == "seeded" and r.drafter == "d")
    assert t.acceptance == 0.5 and t.recall is None and t.precision is None and t.exact is None and t.walk_recall is None


def test_the_baselines_are_measured_on_the_same_pages(world):
    r = next(r for r in world(False).pages().collect() if r.page == "blind")
    assert (r.walk_hits, r.walk_candidates, r.regex_hits, r.regex_candidates) == (0, 1, 2, 3)


def test_consensus_of_several_drafters(spark):
    blocks = spark.createDataFrame([("p", b, "para", ["T"]) for b in "xyz"] + [("p", "h", "heading", ["T", "H"])], BLOCKS)
    t = lambda **tags: {"direction": "absence", "modality": "SHOULD", "unit": "word", **tags}
    rules = [
        ("a", "p", 0, "x", 0, 30, "you must keep it short", t(modality="MUST"), ""), ("b", "p", 0, "x", 5, 20, "keep it short", t(), ""), ("c", "p", 7, "x", 0, 30, "you must keep it short", t(direction="presence"), "seed"),
        ("a", "p", 1, "y", 0, 9, "only one", t(), ""), ("b", "p", 1, "z", 0, 9, "quite other", t(), ""),
    ]
    drafts = spark.createDataFrame(rules, f"drafter string, {RULE}, seed_uid string")
    examples = spark.createDataFrame([("a", "p", 0, "z", 0, 4, "eg", "compliant", 0), ("b", "p", 0, "z", 0, 4, "eg", "violating", 0), ("b", "p", 0, "z", 5, 9, "more", "violating", 1)], "drafter string, " + EXAMPLE)
    drafted = spark.createDataFrame([(d, "p", 0) for d in "abcd"] + [("a", "alone", 0)], "drafter string, page string, refused long")
    families = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one"), ("d", "two")], "drafter string, family string")
    c = C.Consensus(drafted, drafts, examples, families, blocks)
    assert {(r.a, r.b) for r in c.pairs.collect()} == {("a", "b"), ("a", "d"), ("b", "c"), ("c", "d")}
    agreed = {(r.a, r.b): r for r in c.agreed().collect()}
    assert set(agreed) == {("a", "b"), ("b", "c")}
    ab, bc = agreed["a", "b"], agreed["b", "c"]
    assert (ab.start, ab.end, ab.anchor_from, ab.tags["modality"], ab.open) == (5, 20, "b", "SHOULD", [])  # the shorter; soft words alone don't settle for MUST
    assert (bc.start, bc.end, bc.anchor_from, bc.open) == (0, 30, "b", ["direction"])  # a whole heading candidate wins
    items = {(r.a, r.b): (r.singles, r.tag_items) for r in c.items().collect()}
    assert items == {("a", "b"): (2, 0), ("a", "d"): (2, 0), ("b", "c"): (1, 1), ("c", "d"): (1, 0)}
    proposed, kids = c.proposed()
    sizes = {r.drafter: r["count"] for r in proposed.groupBy("drafter").count().collect()}
    assert sizes == {"a + b: agreed": 1, "a + b: either": 3, "a + d: either": 2, "b + c: agreed": 1, "b + c: either": 2, "c + d: either": 1}
    assert {(r.quote, r.kind) for r in kids.where("drafter = 'a + b: agreed'").collect()} == {("eg", "compliant"), ("more", "violating")}
    cells = spark.createDataFrame([("a", "p", 4, 3), ("a", "q", 0, 0), ("b", "p", 4, 1)], "drafter string, page string, golden long, matched long")
    grid = {(r.drafter, r.page): (r.golden, r.matched, r.recall) for r in C.grid(cells, ["drafter", "page"], ["golden", "matched"]).collect()}
    assert grid == {("a", "p"): (4, 3, 0.75), ("a", "q"): (0, 0, None), ("b", "p"): (4, 1, 0.25), ("a", "*"): (4, 3, 0.75), ("b", "*"): (4, 1, 0.25), ("*", "p"): (8, 4, 0.5), ("*", "q"): (0, 0, None), ("*", "*"): (8, 4, 0.5)}


def test_touching_spans_of_two_tables(spark):
    rng = random.Random(3)
    spans = [[(rng.choice("kl"), i, (s := rng.randint(0, 60)), s + rng.choice([0, 1, 4, 40])) for i in range(40)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "k string, i int, start int, end int") for s in spans)
    want = {(x[0], x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in spans[0] for y in spans[1] if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])}
    got = C.touching(a, b, ["k"], ["i"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pages_are_matched_where_they_are_cut(spark):
    """No rule is shuffled, pages that several Arrow batches share stay whole, and the general operators say the same."""
    w = plans.World(spark, SMALL)
    for table in (w.counted(), w.met()):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        scores, tags, items = (q(spark, SMALL) for q in (plans.draft_score, plans.draft_tags, plans.consensus_items))
        scores, tags, items = scores.collect(), tags.collect(), items.collect()
    finally:
        spark.conf.set(key, before)
    scored = C.Scored(w.golden, w.golden_examples, w.drafted, w.drafts, w.draft_examples, w.blocks, w.pages, w.walk, w.directives)
    assert {tuple(r) for r in scores} == {tuple(r[c] for c in scores[0].__fields__) for r in scored.pages().collect()} and len(scores) > 100
    assert {tuple(r) for r in tags} == {tuple(r) for r in scored.tags().groupBy("drafter", "tag").agg(F.sum("agree"), F.sum("compared")).collect()}
    c = w.consensus()
    agreed = {(r.a, r.b): (r["count"], r.must) for r in c.agreed().groupBy("a", "b").agg(F.count("*").alias("count"), F.count_if(F.col("tags")["modality"] == "MUST").alias("must")).collect()}
    assert {(r.a, r.b): (r.agreed, r.must) for r in items} == agreed
    left = {(r.a, r.b): (r.n, r.singles, r.tag_items) for r in c.items().groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("singles").alias("singles"), F.sum("tag_items").alias("tag_items")).collect()}
    assert {(r.a, r.b): (r.pages, r.singles, r.tag_items) for r in items} == left


def test_long_pages_are_not_compared_rule_by_rule():
    rng = random.Random(5)
    say = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    rule = lambda i: C.Rule(i, i, 0, 0, " ".join(["common", *rng.choices(say, k=9)]), False, ("top",))
    a, b = [rule(i) for i in range(300)], [rule(i) for i in range(300)]
    b += [C.Rule(300 + i, i, 0, 0, r.quote + " more", False, ("top",)) for i, r in enumerate(a[:40])]
    like = {(x.i, y.i): n for x in a for y in b if (n := len(x.words & y.words) / len(x.words | y.words)) >= 0.5}
    assert C.likenesses(a, b) == like and len(like) >= 40
    assert sum(1 for _ in C._worded(a, b)) < len(a) * len(b) / 4
