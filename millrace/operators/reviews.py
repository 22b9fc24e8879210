"""Review logs folded into rules: each operation once, in the reviewers' order, judged by the state so far, all or none.

What a row alone tells (its kind, its ids, repeats, unknown rules) is found by joins and windows. Whether a decision is
allowed depends on the decisions before it, so each rule's operations are read once in order: Spark sorts them by rule and
time, and a worker holds one rule's state at a time. The same fold runs over a stream, with the state kept by Spark.
"""

from __future__ import annotations

import copy
import datetime
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from millrace.functions import text as X
from millrace.operators.ledger import EDITABLE, HASTY_MS, LOADABLE, REVIEWER_STATUSES, VOCABULARY
from millrace.session import written

# Kinds of operations, and the tier that each hint of a checker stands for.
KINDS = ("decide", "undo", "example")
TIERS = {"pattern": 0, "lookup": 0, "classifier": 1, "hybrid": 1, "unsure": None}

_S, _I = T.StringType(), T.IntegerType()
_list = lambda *names: T.ArrayType(T.StructType([T.StructField(n, _S) for n in names]))
#: A rule's state, and what an operation says.
FIELDS = T.StructType([T.StructField(n, t) for n, t in (
    *[(n, _S) for n in ("uid", "status", "unit", "clarity", "direction", "modality", "modality_basis", "specification", "violation_condition")], ("applies_to", T.ArrayType(_S)), ("tier", _I),
    ("decided_by", _S), ("decided_at", _S), ("note", _S), ("history", _list("from", "to", "by", "at", "note")), ("assumptions", _list("by", "at", "assumption")),
)])
FOLDED = T.StructType([T.StructField(n, t) for n, t in (("uid", _S), ("op_id", _S), ("source", _S), ("line", _I), ("why", _S), ("rule", FIELDS))])


class Refused(ValueError):
    """An operation that the rule's state does not allow."""


def _when(at: str | None, now: str) -> str:
    try:
        datetime.datetime.fromisoformat((at or "").replace("Z", "+00:00"))
        return at
    except ValueError:
        return now


def _moved(rule: dict, status: str, by: str, at: str, note: str) -> None:
    rule["history"] = [*(rule["history"] or []), {"from": rule["status"], "to": status, "by": by, "at": at, "note": note}]
    rule.update(status=status, decided_by=by, decided_at=at, note=note)


def after(rule: dict, op: dict, now: str) -> dict:
    """The rule after an operation, or Refused; the rule given stays as it is, so a refused patch leaves nothing behind."""
    rule, by, at = copy.copy(rule), op["by"], _when(op["at"], now)
    if op["op"] == "undo":
        if rule["status"] == "proposed":
            raise Refused("nothing to undo")
        _moved(rule, "proposed", by, at, f"undone by {by}")
        return rule
    try:
        patch = json.loads(op["patch"] or "{}")
    except ValueError:
        raise Refused("patch is not JSON") from None
    if not isinstance(patch, dict):
        raise Refused("patch is not an object")
    if unknown := sorted(set(patch) - set(EDITABLE)):
        raise Refused(f"not editable: {unknown[0]}")
    for field, values in VOCABULARY.items():
        if field in patch:
            if patch[field] not in values:
                raise Refused(f"unknown {field}")
            rule[field] = patch[field]
    if "modality" in patch:
        rule["modality_basis"] = f"set by {by} during review"
    if "detection_hint" in patch:
        if patch["detection_hint"] not in TIERS:
            raise Refused("unknown detection_hint")
        rule["tier"] = TIERS[patch["detection_hint"]]
    if "applies_to" in patch:
        rule["applies_to"] = [str(x) for x in patch["applies_to"] or ()] or ["any"]
    for field in ("violation_condition", "specification"):
        if field in patch:
            rule[field] = patch[field]
    status = patch.get("review_status")
    if not status:
        return rule
    if status not in REVIEWER_STATUSES:
        raise Refused("status not settable")
    resolved = rule["clarity"] == "ambiguous_resolvable"
    if resolved and not (rule["specification"] or "").strip():
        raise Refused("interpretation missing")
    if status in LOADABLE and rule["clarity"] == "unreviewed":
        raise Refused("clarity not set")
    reasons = ", ".join(str(r) for r in patch.get("reasons") or () if r)
    hasty = patch.get("elapsed_ms") is not None and patch["elapsed_ms"] < HASTY_MS
    _moved(rule, status, by, at, " ".join(x for x in (f"[{reasons}]" if reasons else "", patch.get("note") or "", "(hasty)" if hasty else "") if x))
    if resolved:
        rule["assumptions"] = [*(rule["assumptions"] or []), {"by": by, "at": at, "assumption": rule["specification"]}]
    return rule


def _folder(now: str):
    schema = to_arrow_schema(FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["op"] is None:
                    if rule is not None:
                        out.append({"uid": rule["uid"], "rule": rule})
                    rule = row["rule"]
                    continue
                why = None
                try:
                    rule = after(rule, row["op"], now)
                except Refused as e:
                    why = str(e)
                out.append({"uid": row["uid"], "why": why, **{k: row["op"][k] for k in ("op_id", "source", "line")}})
            yield pa.RecordBatch.from_pylist(out, schema)
        if rule is not None:
            yield pa.RecordBatch.from_pylist([{"uid": rule["uid"], "rule": rule}], schema)

    return run


class Replayed:
    """The outcome of replay(): ``report``, ``rules`` as they are afterwards, ``examples`` judged, and whether all was refused.

    report: source, line, op, op_id, uid, by, outcome (applied, skipped, error or refused) and why.
    """

    def __init__(self, report: DataFrame, rules: DataFrame, examples: DataFrame, refused: bool):
        self.report, self.rules, self.examples, self.refused = report, rules, examples, refused


def replay(rules: DataFrame, ops: DataFrame, applied: DataFrame, now: str, skip_invalid: bool = False) -> Replayed:
    """Fold the operations that were not applied before into the rules.

    rules: FIELDS; ops: op, op_id, uid, by, at, patch (JSON), source, line, and for examples item_id, rule_uid and verdict;
    applied: op_id. Operations count once by
    id, the first by (at, op_id, source, line), all as texts; ``meta`` rows say nothing. An unknown kind or a missing id is
    always an error. An unknown rule, an example without id or verdict, or a decision that the state does not allow is an
    error too, or is skipped with ``skip_invalid``. One error refuses the whole log: nothing of it is applied.
    """
    place = [F.coalesce("at", F.lit("")), F.coalesce("op_id", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("line", F.lit(0))]
    rows = ops.where(~F.col("op").eqNullSafe("meta")).withColumn("by", X.initials(F.coalesce("by", F.lit("")))).withColumn("__at", F.struct(*[p.alias(f"p{k}") for k, p in enumerate(place)]))
    known = F.coalesce(F.col("op").isin(*KINDS), F.lit(False))
    named = F.coalesce(F.col("op_id"), F.lit("")) != ""
    again = F.row_number().over(Window.partitionBy("op_id", known & named).orderBy("__at")) > 1
    rows = rows.withColumn("__again", again).join(applied.select("op_id").distinct().withColumn("__old", F.lit(True)), "op_id", "left")
    rows = rows.join(rules.select("uid", F.lit(True).alias("__rule")), "uid", "left")
    hard = F.when(~known, "unknown kind").when(~named, "no op_id")
    seen = F.col("__old").isNotNull() | F.col("__again")
    soft = (
        F.when(F.col("op").isin("decide", "undo") & F.col("__rule").isNull(), "unknown rule")
        .when((F.col("op") == "example") & (F.coalesce("item_id", F.lit("")) == ""), "example without id").when((F.col("op") == "example") & (F.coalesce("verdict", F.lit("")) == ""), "example without verdict")
    )
    rows = written(rows.withColumns({"hard": hard, "seen": hard.isNull() & seen, "soft": F.when(hard.isNull() & ~seen, soft)}).drop("__again", "__old", "__rule"))

    op = F.struct("op", "op_id", "by", "at", "patch", "source", "line")
    todo = rows.where("hard IS NULL AND NOT seen AND soft IS NULL AND op <> 'example'").select("uid", F.lit(1).alias("__k"), "__at", op.alias("op"))
    state = rules.select("uid", F.lit(0).alias("__k"), F.lit(None).cast(todo.schema["__at"].dataType).alias("__at"), F.lit(None).cast(todo.schema["op"].dataType).alias("op"), F.struct(*FIELDS.names).cast(FIELDS).alias("rule"))
    both = state.unionByName(todo.withColumn("rule", F.lit(None).cast(FIELDS))).repartition("uid").sortWithinPartitions("uid", "__k", "__at")
    folded = written(both.select("uid", "op", "rule").mapInArrow(_folder(now), FOLDED))

    told = folded.where("op_id IS NOT NULL").select("op_id", "source", "line", F.coalesce("why", F.lit("")).alias("fold"))
    same = [rows[c].eqNullSafe(told[c]) for c in ("source", "line")] + [rows["op_id"] == told["op_id"]]
    report = rows.join(told, same, "left").select(*[rows[c] for c in ("source", "line", "op", "op_id", "uid", "by", "hard", "seen", "soft")], F.nullif("fold", F.lit("")).alias("fold"))
    why = F.coalesce("hard", F.when(F.col("seen"), "already applied"), "soft", "fold")
    outcome = F.when(F.col("hard").isNotNull(), "error").when(F.col("seen"), "skipped").when(why.isNotNull(), "skipped" if skip_invalid else "error").otherwise("applied")
    report = written(report.select("source", "line", "op", "op_id", "uid", "by", outcome.alias("outcome"), why.alias("why")))
    refused = not report.where("outcome = 'error'").isEmpty()
    judged = rows.where("hard IS NULL AND NOT seen AND soft IS NULL AND op = 'example'").select("item_id", "rule_uid", "verdict", "by", "at", "op_id")
    if refused:
        report = report.withColumn("outcome", F.when(F.col("outcome") == "applied", "refused").otherwise(F.col("outcome")))
        return Replayed(report, rules.select(*FIELDS.names), judged.limit(0), True)
    return Replayed(report, folded.where("op_id IS NULL").select("rule.*"), judged, False)


class ReviewFold(StatefulProcessor):
    """The fold over a stream, by rule: the rule's state and the ids applied are kept by Spark, whatever arrives how often.

    Rows of a batch are taken by (at, op_id); what arrives later is folded later. Rows of an unknown rule are told, not kept.
    """

    def __init__(self, now: str):
        self.now = now

    def init(self, handle) -> None:
        self.rule = handle.getValueState("rule", "state string")
        self.seen = handle.getMapState("seen", "op_id string", "n int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.rule.update((json.dumps(json.loads(initialState.iloc[0]["state"])),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows)).sort_values(["at", "op_id"], kind="stable").to_dict("records")
        rule = json.loads(self.rule.get()[0]) if self.rule.exists() else None
        out = []
        for op in ops:
            if self.seen.containsKey((op["op_id"],)):
                why = "already applied"
            elif rule is None:
                why = "unknown rule"
            else:
                self.seen.updateValue((op["op_id"],), (1,))
                why = None
                try:
                    rule = after(rule, op, self.now)
                except Refused as e:
                    why = str(e)
            out.append((key[0], op["op_id"], why, rule and rule["status"], len(rule["history"] or []) if rule else 0))
        if rule is not None:
            self.rule.update((json.dumps(rule),))
        yield pd.DataFrame(out, columns=["uid", "op_id", "why", "status", "moves"])

    def close(self) -> None:
        pass


def stream(ops: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """(uid, op_id, why, status, moves) for each operation of a stream, with the rule's status and number of moves after it.

    The session's state store must be RocksDB's. rules: FIELDS, the state to begin with.
    """
    begin = rules.select("uid", F.to_json(F.struct(*FIELDS.names), {"ignoreNullFields": "false"}).alias("state")).groupBy("uid")
    return ops.select("uid", "op", "op_id", "by", "at", "patch").groupBy("uid").transformWithStateInPandas(
        statefulProcessor=ReviewFold(now), outputStructType="uid string, op_id string, why string, status string, moves int", outputMode="append", timeMode="none", initialState=begin,
    )
