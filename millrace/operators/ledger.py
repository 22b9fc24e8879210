"""The rule ledger: reconciliation, transitions, replay of operation logs, reviewers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.session import dropped, written

DEAD = ("superseded", "orphaned")
LOADABLE = ("accepted", "amended")
POINTS = {"decision": 10, "example": 5, "attention_pass": 25, "attention_fail": -15}


def loadable(rules: DataFrame) -> DataFrame:
    """Rules that may run at all."""
    return rules.where(F.col("status").isin(*LOADABLE) & F.col("detectable") & (F.col("unit") != "artifact") & (F.col("method") != "none"))


def load_reasons(rules: DataFrame) -> DataFrame:
    """Adds skip_reason (null: runs). Rules of other statuses are left out without one."""
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit("")) == ""
    why = (
        F.when(F.col("unit") == "artifact", "unit is artifact")
        .when(~F.col("detectable") | ~F.col("method").isin("regex", "literal_set"), F.concat(F.lit("method "), F.col("method"), F.lit(" cannot run")))
        .when(blank("violation_condition") | (F.size("compliant") < 1) | (F.size("violating") < 1), "no violation condition, or examples of one kind only")
        .when(F.col("clarity").isin("unreviewed", "ambiguous_deferred", "not_automatable"), F.concat(F.lit("clarity is "), F.col("clarity")))
    )
    return rules.where(F.col("status").isin(*LOADABLE)).withColumn("skip_reason", why)


def exact_matches(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, outcome): unchanged, body_altered, declared or open, by the joins that do not depend on order."""
    live = rules.where(~F.col("status").isin(*DEAD)).select(F.col("uid").alias("old_uid"), F.col("body").alias("old_body"))
    own = candidates.join(live, candidates["uid"] == live["old_uid"], "left")
    same = X.strip(X.body_excerpt(F.col("body"))) == X.strip(F.col("old_body"))
    stated = live.select(F.col("old_uid").alias("declared_uid"))
    own = own.join(stated, own["supersedes"] == stated["declared_uid"], "left")
    outcome = F.when(F.col("old_uid").isNotNull() & same, "unchanged").when(F.col("old_uid").isNotNull(), "body_altered").when(F.col("declared_uid").isNotNull(), "reworded").otherwise("open")
    return own.select("uid", outcome.alias("outcome"))


def reconcile(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(outcome, old_uid, cand_uid) of the whole cascade: by uid, declared, same statement, same place, else added; the rest orphaned.

    Later steps consume rules in the candidates' order (page, line, uid), and only candidates and rules that share a
    statement, a place or a declaration can meet. The cascade runs per connected group of those keys, so groups stay
    apart in parallel and each is as small as the ties that bind it.
    """
    c = candidates.select("uid", "page", "parent", "statement", "body", "line", "positional", "supersedes").withColumn("old", F.lit(False))
    live = rules.where(~F.col("status").isin(*DEAD))
    r = live.select("uid", "page", "parent", "statement", "body", F.lit(None).cast("int").alias("line"), F.lit(None).cast("boolean").alias("positional"), F.lit(None).cast("string").alias("supersedes")).withColumn("old", F.lit(True))
    both = c.unionByName(r).withColumn("key", X.normalise_statement(F.col("statement")))
    both = both.withColumn("node", F.concat(F.when(F.col("old"), "r:").otherwise("c:"), "uid"))
    links = both.select("node", F.explode(F.array_compact(F.array(F.concat(F.lit("u:"), "uid"), F.concat(F.lit("s:"), "key"), F.concat(F.lit("p:"), "page", F.lit("\0"), "parent"), F.when(F.col("supersedes").isNotNull(), F.concat(F.lit("u:"), "supersedes"))))).alias("tie"))
    groups = _groups(links)
    rows = both.join(groups, "node")
    present = c.select(F.col("uid"), F.lit(True).alias("produced"))
    rows = rows.join(present, "uid", "left").withColumn("produced", F.coalesce("produced", F.lit(False)))
    # groups are small and many: a task reads its own in order and holds one at a time
    rows = rows.select("grp", *Tied._fields).repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(_cascades, "outcome string, old_uid string, cand_uid string")


def _groups(links: DataFrame) -> DataFrame:
    """(node, grp): components of the graph of nodes and ties.

    A round hands the smallest name to all that share a tie, and then to each node the name that its name now has, so
    names travel twice as far every round.
    """
    links = written(links)
    now = written(links.select("node", F.col("node").alias("grp")).distinct())
    while True:
        by_tie = links.join(now, "node").groupBy("tie").agg(F.min("grp").alias("low"))
        near = links.join(by_tie, "tie").groupBy("node").agg(F.min("low").alias("grp"))
        jump = near.select(F.col("node").alias("grp"), F.col("grp").alias("further"))
        after = written(near.join(jump, "grp", "left").select("node", F.least("grp", F.coalesce("further", "grp")).alias("grp")))
        moved = not after.join(now.withColumnRenamed("grp", "was"), "node").where("grp <> was").isEmpty()
        dropped(now)
        now = after
        if not moved:
            dropped(links)
            return now


class Tied(NamedTuple):
    """A candidate, or a live rule (old); produced: some candidate has its uid."""

    old: bool
    uid: str
    page: str
    parent: str
    key: str
    body: str | None
    line: int | None
    positional: bool | None
    supersedes: str | None
    produced: bool


def _cascades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cascade of each group, whose rows follow one another."""
    each = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    outcomes = chain.from_iterable(_cascade([Tied(*r[1:]) for r in rows]) for _, rows in groupby(each, lambda r: r[0]))
    while some := list(islice(outcomes, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["outcome", "old_uid", "cand_uid"])


def _cascade(rows: list[Tied]) -> list[tuple]:
    """(outcome, old_uid, cand_uid): the cascade inside one group, in the candidates' order; live rules are found by statement and by place."""
    old = {r.uid: r for r in sorted((r for r in rows if r.old), key=lambda r: r.uid)}
    told: dict[str, dict[str, None]] = {}
    placed: dict[tuple, dict[str, None]] = {}
    for u, r in old.items():
        if not r.produced:
            told.setdefault(r.key, {})[u] = None
            placed.setdefault((r.page, r.parent), {})[u] = None
    used: set[str] = set()

    def take(uid: str) -> None:
        used.add(uid)
        told.get(old[uid].key, {}).pop(uid, None)
        placed.get((old[uid].page, old[uid].parent), {}).pop(uid, None)

    out = []
    known = lambda v: (v is None, v)  # noqa: E731  what is not known comes last
    for c in sorted((r for r in rows if not r.old), key=lambda r: (known(r.page), known(r.line), r.uid)):
        if c.uid in old:
            take(c.uid)
            same = (old[c.uid].body or "").strip() == (c.body or "")[:1200].strip()
            out.append(("unchanged" if same else "body_altered", c.uid, c.uid))
            continue
        if c.supersedes and c.supersedes in old and c.supersedes not in used:
            take(c.supersedes)
            out.append(("reworded", c.supersedes, c.uid))
            continue
        tied, kind = list(told.get(c.key, ())), "rehomed"
        if len(tied) > 1 and len(here := [u for u in tied if old[u].page == c.page]) == 1:
            tied = here
        if not tied and c.positional:
            tied, kind = list(placed.get((c.page, c.parent), ())), "reworded"
        if len(tied) == 1:
            take(tied[0])
            out.append((kind, tied[0], c.uid))
        elif tied:
            out.append(("ambiguous", tied[0], c.uid))
        else:
            out.append(("added", None, c.uid))
    return out + [("orphaned", u, None) for u, r in old.items() if u not in used and not r.produced]


def last_op(ops: DataFrame, key: str, at: str, op_id: str) -> DataFrame:
    """The last operation of each key: operations count once by id, the order is (at, op_id)."""
    once = ops.groupBy(op_id).agg(F.min(F.struct(*[c for c in ops.columns if c != op_id])).alias("o")).select(op_id, "o.*")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(op_id).desc()))).where("__n = 1").drop("__n")


def new_ops(ops: DataFrame, applied: DataFrame, op_id: str = "op_id") -> DataFrame:
    """Operations not applied before."""
    return ops.join(applied.select(op_id), op_id, "left_anti")


def transitions(rules: DataFrame, ops: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Rules with their decisions folded in: history grows in order, the last decision is the status. An unknown status raises when the row is read."""
    known = F.col("to").isin(*(statuses or STATUSES))
    ops = ops.withColumn("to", F.when(known, F.col("to")).otherwise(F.raise_error(F.concat(F.lit("unknown review status: "), F.coalesce("to", F.lit("null"))))))
    moves = ops.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "op_id", "by", F.col("to").alias("to")))).alias("moves"))
    out = rules.join(moves, "uid", "left")
    done = F.coalesce("moves", F.array().cast("array<struct<at:string,op_id:string,by:string,to:string>>"))
    return out.withColumn("history", done).withColumn("status", F.coalesce(F.get(F.col("history"), F.size("history") - 1)["to"], "status")).drop("moves")


def leaderboard(work: DataFrame, since: Column | None = None) -> DataFrame:
    """who, decisions, hasty, examples, checks_passed, checks_failed, score, accuracy, rank. work: (at, by, kind, good)."""
    rows = work if since is None else work.where(F.col("at") >= since)
    who = X.initials(F.col("by"))
    n = lambda cond: F.count_if(cond).cast("long")
    k, good = F.col("kind"), F.coalesce(F.col("good"), F.lit(False))
    got = rows.where("kind <> 'undo'").groupBy(who.alias("who")).agg(
        n(k.isin("decision", "hasty")).alias("decisions"), n(k == "hasty").alias("hasty"), n(k == "example").alias("examples"),
        n((k == "attention") & good).alias("checks_passed"), n((k == "attention") & ~good).alias("checks_failed"),
    )
    score = (F.col("decisions") - F.col("hasty")) * POINTS["decision"] + F.col("examples") * POINTS["example"] + F.col("checks_passed") * POINTS["attention_pass"] + F.col("checks_failed") * POINTS["attention_fail"]
    checks = F.col("checks_passed") + F.col("checks_failed")
    got = got.withColumn("score", score).withColumn("accuracy", F.when(checks > 0, F.bround(100.0 * F.col("checks_passed") / checks, 0).cast("long")))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "who")).cast("long"))  # one row per reviewer


def agreement(verdicts: DataFrame) -> DataFrame:
    """One row: rules with two reviewers or more, how many agree, the rounded share. verdicts: (uid, by, at, verdict)."""
    last = verdicts.groupBy("uid", X.initials(F.col("by")).alias("who")).agg(F.max_by("verdict", F.struct("at", "verdict")).alias("v"))
    by_rule = last.groupBy("uid").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).where("n > 1")
    got = by_rule.agg(F.count("*").alias("double_reviewed"), F.count_if(F.col("d") == 1).alias("agreed"))
    return got.withColumn("rate", F.when(F.col("double_reviewed") > 0, F.bround(100.0 * F.col("agreed") / F.col("double_reviewed"), 0).cast("long")))


def violations(rules: DataFrame) -> DataFrame:
    """(uid, contract) of rules that break a conditional contract of the schema."""
    broken = F.array_compact(F.array(
        F.when(F.col("detectable") & (F.coalesce(F.col("violation_condition"), F.lit("")) == ""), "detectable needs a violation condition"),
        F.when(F.col("detectable") & ((F.size("compliant") < 1) | (F.size("violating") < 1)), "detectable needs both kinds of examples"),
        F.when((F.col("unit") == "artifact") & F.col("detectable"), "an artifact is not detectable"),
        F.when((F.col("clarity") == "ambiguous_resolvable") & (F.coalesce(F.col("specification"), F.lit("")) == ""), "resolvable needs a specification"),
    ))
    return rules.select("uid", F.explode(broken).alias("contract"))


# What a reviewer may set, and when a decision was too fast to be one.
VOCABULARY = {
    "unit": ("character", "token", "phrase", "sentence", "paragraph", "block", "section", "document", "artifact"),
    "clarity": ("unreviewed", "unambiguous", "ambiguous_resolvable", "ambiguous_deferred", "not_automatable"),
    "direction": ("presence", "absence"),
    "modality": ("MUST", "MUST_NOT", "SHOULD", "SHOULD_NOT", "MAY", "PREFER"),
}
STATUSES = ("proposed", "accepted", "amended", "rejected", "deferred", "quarantined", "superseded", "orphaned")
REVIEWER_STATUSES = ("accepted", "amended", "rejected", "deferred")
HASTY_MS = 2500
EDITABLE = ("review_status", "unit", "applies_to", "clarity", "direction", "modality", "violation_condition", "specification", "note", "reasons", "elapsed_ms", "detection_hint")


def patched(rules: DataFrame, patches: DataFrame, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """A row a patch, whole or not at all: reject_reason, and the rule's status, unit, clarity, direction, modality, specification and note after it.

    rules: uid, status, unit, clarity, direction, modality, specification; patches: uid, fields (names the patch sets),
    status, unit, clarity, direction, modality, specification, note, reasons, elapsed_ms; null where not set. One patch a rule.
    """
    names = ("status", "unit", "clarity", "direction", "modality", "specification")
    editable = F.array(*map(F.lit, EDITABLE))
    was = rules.select("uid", *[F.col(c).alias(f"was_{c}") for c in names])
    rows = patches.join(was, "uid")
    new = {c: F.coalesce(c, f"was_{c}") for c in names}
    spec = F.coalesce(X.strip(new["specification"]), F.lit("")) == ""
    why = F.when(F.size(F.array_except("fields", editable)) > 0, "field not editable")
    for c, values in vocabulary.items():
        why = why.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), f"unknown {c}")
    why = (
        why.when(F.col("status").isNotNull() & ~F.col("status").isin(*REVIEWER_STATUSES), "status not settable")
        .when(F.col("status").isNotNull() & (new["clarity"] == "ambiguous_resolvable") & spec, "interpretation missing")
        .when(F.col("status").isin(*LOADABLE) & (new["clarity"] == "unreviewed"), "clarity not set")
    )
    listed = F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: r != "")
    note = F.concat_ws(" ", F.when(F.size(listed) > 0, F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]"))), F.when(F.coalesce("note", F.lit("")) != "", F.col("note")), F.when(F.col("elapsed_ms") < HASTY_MS, "(hasty)"))
    rows = rows.withColumn("reject_reason", why)
    held = F.col("reject_reason").isNotNull()
    return rows.select("uid", "reject_reason", *[F.when(held, F.col(f"was_{c}")).otherwise(v).alias(c) for c, v in new.items()], F.when(~held & F.col("status").isNotNull(), note).alias("note"))
