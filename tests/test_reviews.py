import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger as L
from millrace.operators import reviews as V

OPS = "op string, op_id string, uid string, by string, at string, patch string, source string, line int, item_id string, rule_uid string, verdict string"
NOW = "2030-01-01"


def rules_of(spark, *rules):
    rows = [{f: None for f in V.FIELDS.names} | {"status": "proposed", "unit": "sentence", "clarity": "unreviewed", "direction": "absence", "modality": "SHOULD"} | r for r in rules]
    return spark.createDataFrame([tuple(r[f] for f in V.FIELDS.names) for r in rows], V.FIELDS)


def op(kind, op_id, uid=None, at="2026-01-01T00:00:00Z", by="ta", line=0, source="f", item=None, verdict=None, **patch):
    return (kind, op_id, uid, by, at, json.dumps(patch) if patch else None, source, line, item, uid, verdict)


def run(spark, rules, ops, applied=(), **how):
    got = V.replay(rules_of(spark, *rules), spark.createDataFrame(ops, OPS), spark.createDataFrame([(a,) for a in applied], "op_id string"), NOW, **how)
    return got, {(r.op_id, r.line): (r.outcome, r.why) for r in got.report.collect()}, {r.uid: r for r in got.rules.collect()}


def test_decisions_are_judged_in_order(spark):
    ops = [
        op("decide", "3", "r", at="2026-01-03", review_status="accepted", reasons=["ok", ""], note="fine", elapsed_ms=100), op("decide", "1", "r", at="2026-01-01", clarity="unambiguous", unit="phrase"),
        op("undo", "4", "r", at="2026-01-04", by="b.o"), op("decide", "5", "r", at="2026-01-05", clarity="ambiguous_resolvable", specification="read so", review_status="amended", applies_to=[], detection_hint="pattern", modality="MUST"),
        op("meta", None), op("decide", "6", "s", at="not a time", clarity="unambiguous", review_status="rejected"),
    ]
    got, report, rules = run(spark, [{"uid": "r"}, {"uid": "s"}, {"uid": "t"}], ops)
    assert not got.refused and {o for o, _ in report.values()} == {"applied"} and len(report) == 5
    r = rules["r"]
    assert (r.status, r.clarity, r.unit, r.specification, r.applies_to, r.tier, r.modality_basis) == ("amended", "ambiguous_resolvable", "phrase", "read so", ["any"], 0, "set by TA during review")
    assert [(h["from"], h["to"], h["by"], h["at"], h["note"]) for h in r.history] == [("proposed", "accepted", "TA", "2026-01-03", "[ok] fine (hasty)"), ("accepted", "proposed", "BO", "2026-01-04", "undone by BO"), ("proposed", "amended", "TA", "2026-01-05", "")]
    assert [tuple(a) for a in r.assumptions] == [("TA", "2026-01-05", "read so")]
    assert (rules["s"].status, rules["s"].decided_at) == ("rejected", NOW) and rules["t"].status == "proposed" and rules["t"].history is None


BAD = [
    (op("decide", "x", "r", uid_="no"), "not editable: uid_"), (op("decide", "x", "r", unit="page"), "unknown unit"), (op("decide", "x", "r", detection_hint="magic"), "unknown detection_hint"),
    (op("decide", "x", "r", review_status="superseded"), "status not settable"), (op("decide", "x", "r", review_status="accepted"), "clarity not set"), (op("decide", "x", "r", clarity="ambiguous_resolvable", review_status="rejected", note="here"), "interpretation missing"),
    (op("decide", "x", "gone", unit="phrase"), "unknown rule"), (op("undo", "x", "r"), "nothing to undo"), (op("example", "x", "r", verdict="keep"), "example without id"), (op("example", "x", "r", item="i"), "example without verdict"),
    (("decide", "x", "r", "a", "", "{", "f", 0, None, None, None), "patch is not JSON"), (("decide", "x", "r", "a", "", "[1]", "f", 0, None, None, None), "patch is not an object"),
]


@pytest.mark.parametrize("skip", [False, True])
def test_one_error_refuses_the_whole_log(spark, skip):
    """Every kind of invalid row at once: without skip_invalid nothing is applied, with it the rest is."""
    bad = [(*row[:1], f"x{n}", *row[2:7], n, *row[8:]) for n, (row, _) in enumerate(BAD)]
    good = op("decide", "ok", "s", line=99, clarity="unambiguous", review_status="accepted")
    got, report, rules = run(spark, [{"uid": "r"}, {"uid": "s"}], [*bad, good], skip_invalid=skip)
    assert {k: v for k, v in report.items() if k[0] != "ok"} == {(f"x{n}", n): ("skipped" if skip else "error", why) for n, (_, why) in enumerate(BAD)}
    assert report["ok", 99] == (("applied", None) if skip else ("refused", None)) and got.refused is not skip
    assert rules["s"].status == ("accepted" if skip else "proposed")
    assert rules["r"].clarity == "unreviewed" and rules["r"].unit == "sentence"  # a refused patch leaves nothing behind


def test_kinds_and_ids_are_errors_that_nothing_skips(spark):
    got, report, rules = run(spark, [{"uid": "r"}], [op("shout", "a", "r"), op("undo", "", "r", line=1), op("undo", None, "r", line=2), op(None, "b", "r", line=3), op("decide", "c", "r", line=4, unit="phrase")], skip_invalid=True)
    assert got.refused and report == {("a", 0): ("error", "unknown kind"), ("", 1): ("error", "no op_id"), (None, 2): ("error", "no op_id"), ("b", 3): ("error", "unknown kind"), ("c", 4): ("refused", None)}
    assert rules["r"].unit == "sentence"


def test_replaying_is_safe(spark):
    ops = [op("decide", "a", "r", unit="phrase"), op("decide", "a", "r", line=1, unit="token"), op("undo", "old", "r", line=2), op("example", "e", "r", line=3, item="i", verdict="keep")]
    got, report, rules = run(spark, [{"uid": "r"}], ops, applied=["old", "old"])
    assert report == {("a", 0): ("applied", None), ("a", 1): ("skipped", "already applied"), ("old", 2): ("skipped", "already applied"), ("e", 3): ("applied", None)}
    assert rules["r"].unit == "phrase" and [(x.item_id, x.verdict) for x in got.examples.collect()] == [("i", "keep")]
    again, report, _ = run(spark, [{"uid": "r"}], ops, applied=["old", "a", "e"])
    assert {o for o, _ in report.values()} == {"skipped"} and not again.refused
    empty, report, rules = run(spark, [{"uid": "r"}], [])
    assert report == {} and not empty.refused and rules["r"].status == "proposed"


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ops = [op("decide", "1", "r", at="1", clarity="unambiguous"), op("decide", "2", "r", at="2", review_status="accepted"), op("undo", "3", "r", at="3"), op("decide", "4", "gone", at="4", unit="phrase"), op("undo", "5", "r", at="5")]
        schema = spark.createDataFrame([], OPS).schema
        folder = tmp_path / "ops"
        for n, batch in enumerate([ops[:2], ops[1:4], ops[2:]]):  # files overlap
            spark.createDataFrame(batch, OPS).coalesce(1).write.mode("append").json(str(folder / f"n={n}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))
        run = V.stream(source, rules_of(spark, {"uid": "r"}, {"uid": "s"}), NOW).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        got = spark.table("folded").collect()
        applied = {r.op_id: (r.why, r.status, r.moves) for r in got if r.why != "already applied" and r.uid == "r"}
        assert applied == {"1": (None, "proposed", 0), "2": (None, "accepted", 1), "3": (None, "proposed", 2), "5": ("nothing to undo", "proposed", 2)}
        assert sorted(r.op_id for r in got if r.why == "already applied") == ["2", "3"]
        assert {r.why for r in got if r.uid == "gone"} == {"unknown rule"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_unknown_statuses_raise(spark):
    rules = spark.createDataFrame([("r", "proposed")], "uid string, status string")
    moves = spark.createDataFrame([("r", "1", "a", "x", "accepted")], "uid string, at string, op_id string, by string, to string")
    assert L.transitions(rules, moves).first().status == "accepted"
    with pytest.raises(Exception, match="unknown review status"):
        L.transitions(rules, moves.withColumn("to", F.lit("liked"))).collect()
