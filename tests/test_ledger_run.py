"""From pages to the next ledger, twice: every column of what a change of the pages does."""

import random

from pyspark.sql import functions as F

from millrace.operators import extract as R
from millrace.operators import structure as B
from millrace.operators.blocks import block_id, nodes

VERBS = ("use", "write", "keep", "spell")
SPANS = "span_id string, page string, block_id string, start int, end int, kind string, of string, grp string, quote string, seed_uid string"
OLD = {
    "a": "# Use this title\n\n## Use short words\n\nShort ones are read.\n\n### Write this\n\n- See [Help](x) [Verb]\n- [gloss only]\n- now\n\n### Not this\n\nfacilitate\n\n## Noun trains are hard\n\n### Correct\n\na list\n\n### Incorrect\n\nlist item order form\n\n## About words\n\nplain\n",
    "b": "# B\n\n## Keep dates whole\n\nOld body\n\n## Spell out numbers\n\n## Never shout\n",
    "c": "# C\n\n## Write to people\n\nDon’t use slang here. More.\n",
}
NEW = {
    "a": OLD["a"].replace("Short ones are read.", "Short ones are read fast."),
    "b": "# B\n\n## Keep dates in full\n\nOld body\n\n## Use colour well\n",
    "c": OLD["c"] + "\n## Spell out numbers\n\nHere now\n",
}


def uid_of(page, path, statement):
    import hashlib

    return hashlib.blake2s("\0".join((page, " > ".join(path), statement)).encode(), digest_size=8).hexdigest()


def ledger(spark, texts, rules, spans=(), swept=(), now="t1", known=None):
    pages = B.normalised_pages(spark.createDataFrame(list(texts.items()), "page string, raw string").withColumnRenamed("page", "path")).select(F.col("path").alias("page"), "text", "sha256")
    urls = spark.createDataFrame([("a", "https://x/a")], "page string, url string")
    marks = spark.createDataFrame(list(spans), SPANS)
    done = spark.createDataFrame([(s,) for s in swept], "page string")
    if rules is None:
        empty = R.as_rules(R.heading_candidates(nodes(pages).limit(0), VERBS).withColumn("origin", F.lit("heading")), urls, pages.select("page", "sha256"), "t0")
        rules = empty
    return R.next_ledger(pages, marks, done, rules, urls, now, VERBS, known)


def test_first_run_admits_what_the_pages_say(spark):
    got, outcomes = ledger(spark, OLD, None, now="t0")
    rows = {r.statement: r for r in got.collect()}
    assert set(rows) == {"Use short words", "Noun trains are hard", "Keep dates whole", "Spell out numbers", "Never shout", "Write to people"}
    assert {r.outcome for r in outcomes.collect()} == {"added"}
    r = rows["Use short words"].asDict(recursive=True)
    assert r == {
        "uid": uid_of("a", ["Use this title", "Use short words"], "Use short words"), "page": "a", "path": ["Use this title", "Use short words"], "statement": "Use short words", "url": "https://x/a", "body": "Short ones are read.",
        "sha256": r["sha256"], "line": 2, "method": "heading_structure", "version": "1", "form": "imperative", "derived_at": "t0", "modality": "MUST", "modality_basis": r["modality_basis"], "clarity": "unreviewed", "direction": "absence",
        "unit": "sentence", "preconditions": [], "compliant": ["See Help", "now"], "violating": ["facilitate"], "detectable": False, "not_detectable_reason": "awaiting review", "status": "proposed", "history": [], "supersedes": None, "uid_history": [], "note": "",
    }
    assert len(r["sha256"]) == 64
    n = rows["Noun trains are hard"]
    assert (n.form, n.modality, n.compliant, n.violating) == ("exemplified", "SHOULD", ["a list"], ["list item order form"])
    assert (rows["Never shout"].form, rows["Never shout"].direction, rows["Never shout"].modality) == ("negative_imperative", "presence", "SHOULD_NOT")
    assert rows["Write to people"].url == ""


def test_second_run_follows_the_pages(spark):
    rules, _ = ledger(spark, OLD, None, now="t0")
    state = {"Use short words": "accepted", "Never shout": "rejected"}
    status = F.coalesce(*[F.when(F.col("statement") == k, v) for k, v in state.items()], F.lit("proposed"))
    rules = rules.withColumn("status", status).withColumn("note", F.lit("mine"))
    slang, told = "Don’t use slang here.", "Don't use slang here."
    at = block_id("c", ["C", "Write to people"], slang + " More.", 0)
    eg = block_id("c", ["C", "Spell out numbers"], "Here now", 0)
    spans = [("s1", "c", at, 0, len(slang), "rule", None, None, slang, uid_of("c", ["C", "Write to people"], "Write to people")), ("s2", "c", eg, 0, 4, "compliant", "s1", None, "Here", None), ("s3", "c", eg, 5, 8, "precondition", "s1", None, "now", None)]
    got, outcomes = ledger(spark, NEW, rules, spans, ["c"], "t1")
    rows = {(r.page, r.statement): r for r in got.collect()}
    named = {r.uid: k for k, r in rows.items()}
    said = {(o.outcome, named.get(o.old_uid, (None, None))[1], named.get(o.cand_uid, (None, None))[1]) for o in outcomes.collect()}
    assert {x for x in said if x[0] != "ambiguous"} == {
        ("body_altered", "Use short words", "Use short words"), ("unchanged", "Noun trains are hard", "Noun trains are hard"), ("reworded", "Write to people", told),
        ("orphaned", "Keep dates whole", None), ("orphaned", "Spell out numbers", None), ("orphaned", "Never shout", None),
    }
    # three rules of one section are gone and two are new: no one can tell which is which, so the old ones stay orphaned
    assert {x[2] for x in said if x[0] == "ambiguous"} == {"Keep dates in full", "Use colour well"}
    assert all(rows["b", s].note.startswith("LINEAGE UNRESOLVED: may supersede ") and rows["b", s].status == "proposed" for s in ("Keep dates in full", "Use colour well"))
    short = rows["a", "Use short words"]
    assert (short.status, short.body, short.note, short.history) == ("accepted", "Short ones are read fast.", "mine", [])
    new = rows["c", told]
    assert (new.method, new.status, new.supersedes, new.compliant, new.violating, new.preconditions) == ("human_span", "proposed", uid_of("c", ["C", "Write to people"], "Write to people"), ["Here"], [], ["now"])
    assert (new.path, new.form, new.body, new.line) == (["C", "Write to people"], "negative_imperative", "Don’t use slang here. More.", 4)
    gone = rows["c", "Write to people"]
    assert gone.status == "superseded" and [(h["from"], h["to"], h["by"], h["at"]) for h in gone.history] == [("proposed", "superseded", "build", "t1")]
    shout = rows["b", "Never shout"]
    assert shout.status == "orphaned" and shout.history[0]["from"] == "rejected"  # page b is not swept
    assert ("c", "Spell out numbers") not in rows  # c is swept, and no one marked that heading
    assert all(r.sha256 for r in rows.values())


def test_outside_verdicts_only_admit(spark):
    known = spark.createDataFrame([("About words", True), ("Use short words", False)], "title string, verdict boolean")
    got, _ = ledger(spark, OLD, None, known=known)
    names = {r.statement: r.form for r in got.collect()}
    assert names["About words"] == "imperative" and "Use short words" in names


def test_children_of_repeated_headings_stay_apart(spark):
    text = "# T\n\n## Trains\n\n### Correct\n\nx\n\n## Trains\n\n### Incorrect\n\ny\n"
    found = nodes(spark.createDataFrame([("p", text)], "page string, text string"))
    assert {(r.line, r.paired, tuple(r.examples)) for r in R.harvested(found).collect()} == {(2, False, ("correct",)), (8, False, ("incorrect",))}
    assert R.heading_candidates(found, VERBS).count() == 0


def test_nodes_equal_the_windows(spark):
    """The pass inside a row and the windows over lines give the same trees and bodies."""
    rng = random.Random(6)
    say = ["# a", "## b ##", "### c", "###### f", "text", "", "```", "  ~~~ x", "#no", "####### seven", "  # indented", "# "]
    df = spark.createDataFrame([(i, "\n".join(rng.choices(say, k=rng.randint(0, 25)))) for i in range(60)] + [(99, None)], "page int, text string")
    lines = B.lines(df)
    heads = B.headings(lines)
    want = B.ancestry(heads, trail="trail").join(B.bodies(lines, heads), ["page", "line"], "left").select("page", "line", "level", "title", "path", "trail", F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "").alias("body"))
    assert sorted(map(tuple, nodes(df).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
