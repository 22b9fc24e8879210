"""Queries over review logs: operations with refusals, folded into rules. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import reviews as V
from millrace.plans.catalogue import query, read

NOW = "2030-01-01T00:00:00"


def _log(spark, d):
    """Events as a review log: views set a clarity, clicks decide, purchases write an interpretation and amend, errors undo, signups judge an example; large values come twice."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    clarity = F.when(F.col("k") < 40, "unambiguous").when(F.col("k") < 80, "ambiguous_resolvable").otherwise("murky")
    status = F.when(F.col("value") < 20, "accepted").otherwise("rejected")
    patch = (
        F.when(kind == "view", F.to_json(F.struct(clarity.alias("clarity"))))
        .when(kind == "click", F.to_json(F.struct(status.alias("review_status"), (F.col("k") * 100).alias("elapsed_ms"))))
        .when(kind == "purchase", F.to_json(F.struct(F.when(F.col("k") < 30, " ").otherwise(F.concat(F.lit("s"), "k")).alias("specification"), F.lit("amended").alias("review_status"))))
    )
    op = F.when(kind == "error", "undo").when(kind == "signup", "example").otherwise("decide")
    rows = e.select(
        op.alias("op"), F.col("event_id").cast("string").alias("op_id"), F.concat(F.lit("u"), "user_id").alias("uid"), F.concat(F.lit("r."), F.col("user_id") % 23).alias("by"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), patch.alias("patch"), F.lit("a").alias("source"), F.col("event_id").cast("int").alias("line"), F.when(F.col("k") >= 5, F.col("k").cast("string")).alias("item_id"),
        F.concat(F.lit("u"), "user_id").alias("rule_uid"), F.when(F.col("value") > 1, "keep").alias("verdict"), "value", kind.alias("kind"),
    )
    ops = rows.unionByName(rows.where("value > 50").withColumn("source", F.lit("b"))).drop("value", "kind")
    none = lambda t: F.lit(None).cast(t)
    buyers = rows.where("kind = 'purchase'").groupBy("uid").agg(F.sum("value").alias("v")).where("v > 200")
    named = {"status": F.lit("proposed"), "unit": F.lit("sentence"), "clarity": F.lit("unreviewed"), "direction": F.lit("absence"), "modality": F.lit("SHOULD")}
    rules = buyers.select("uid", *[named.get(f.name, none(f.dataType)).alias(f.name) for f in V.FIELDS.fields if f.name != "uid"])
    return rules, ops, rows.where("value < 0.5").select("op_id")


_LOG = """
WITH RECURSIVE e AS (
    SELECT *, json_extract_string(props, '$.k')::INTEGER AS k, 'u' || user_id AS uid, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, event_id::VARCHAR AS op_id FROM events
), rules AS (
    SELECT uid FROM e WHERE event_type = 'purchase' GROUP BY uid HAVING sum(value) > 200
), log AS (
    SELECT *, 'a' AS source FROM e UNION ALL SELECT *, 'b' FROM e WHERE value > 50
), judged AS (
    SELECT log.*, CASE WHEN value < 0.5 OR row_number() OVER (PARTITION BY op_id ORDER BY source) > 1 THEN 'already applied' END AS seen,
        CASE WHEN event_type = 'signup' THEN CASE WHEN k < 5 THEN 'example without id' WHEN value <= 1 THEN 'example without verdict' END WHEN rules.uid IS NULL THEN 'unknown rule' END AS soft
    FROM log LEFT JOIN rules USING (uid)
), todo AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY stamp, op_id) AS n, CASE WHEN k < 40 THEN 'unambiguous' WHEN k < 80 THEN 'ambiguous_resolvable' ELSE 'murky' END AS clear, CASE WHEN k < 30 THEN ' ' ELSE 's' || k END AS spec
    FROM judged WHERE seen IS NULL AND soft IS NULL AND event_type <> 'signup'
), fold AS (
    SELECT uid, 0::BIGINT AS n, NULL::VARCHAR AS op_id, 'proposed' AS status, 'unreviewed' AS clarity, NULL::VARCHAR AS specification, 0::BIGINT AS moves, 0::BIGINT AS hasty, 0::BIGINT AS assumptions, NULL::VARCHAR AS why FROM rules
    UNION ALL
    SELECT uid, n, op_id, CASE WHEN why IS NOT NULL THEN status WHEN event_type = 'error' THEN 'proposed' WHEN event_type = 'click' THEN CASE WHEN value < 20 THEN 'accepted' ELSE 'rejected' END WHEN event_type = 'purchase' THEN 'amended' ELSE status END,
        CASE WHEN why IS NULL AND event_type = 'view' THEN clear ELSE clarity END, CASE WHEN why IS NULL AND event_type = 'purchase' THEN spec ELSE specification END,
        moves + CASE WHEN why IS NULL AND event_type <> 'view' THEN 1 ELSE 0 END, hasty + CASE WHEN why IS NULL AND event_type = 'click' AND k * 100 < 2500 THEN 1 ELSE 0 END,
        assumptions + CASE WHEN why IS NULL AND event_type IN ('click', 'purchase') AND clarity = 'ambiguous_resolvable' THEN 1 ELSE 0 END, why
    FROM (
        SELECT f.uid, t.n, t.op_id, f.status, f.clarity, f.specification, f.moves, f.hasty, f.assumptions, t.event_type, t.k, t.value, t.clear, t.spec,
            CASE t.event_type WHEN 'error' THEN CASE WHEN f.status = 'proposed' THEN 'nothing to undo' END WHEN 'view' THEN CASE WHEN t.clear = 'murky' THEN 'unknown clarity' END
                WHEN 'click' THEN CASE WHEN f.clarity = 'ambiguous_resolvable' AND trim(coalesce(f.specification, '')) = '' THEN 'interpretation missing' WHEN t.value < 20 AND f.clarity = 'unreviewed' THEN 'clarity not set' END
                ELSE CASE WHEN f.clarity = 'ambiguous_resolvable' AND trim(t.spec) = '' THEN 'interpretation missing' WHEN f.clarity = 'unreviewed' THEN 'clarity not set' END END AS why
        FROM fold f JOIN todo t ON t.uid = f.uid AND t.n = f.n + 1
    )
)"""


@query(_LOG + """
SELECT j.op_id, j.source, j.uid, CASE WHEN coalesce(seen, soft, fold.why) IS NULL THEN 'applied' ELSE 'skipped' END AS outcome, coalesce(seen, soft, fold.why) AS why
FROM judged j LEFT JOIN fold ON fold.op_id = j.op_id AND j.seen IS NULL
""")
def review_report(spark, d):
    """Every operation of a log: applied, or skipped and why; decisions are judged by the state that those before them left."""
    rules, ops, applied = _log(spark, d)
    return V.replay(rules, ops, applied, NOW, skip_invalid=True).report.select("op_id", "source", "uid", "outcome", "why")


@query(_LOG + " SELECT uid, status, clarity, specification, moves, hasty, assumptions FROM fold QUALIFY n = max(n) OVER (PARTITION BY uid)")
def review_replay(spark, d):
    """The rules after a log of decisions and undos."""
    rules, ops, applied = _log(spark, d)
    after = V.replay(rules, ops, applied, NOW, skip_invalid=True).rules
    hasty = F.size(F.filter(F.coalesce("history", F.array().cast(V.FIELDS["history"].dataType)), lambda h: h["note"].endswith("(hasty)"))).cast("long")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return after.select("uid", "status", "clarity", "specification", size("history").alias("moves"), hasty.alias("hasty"), size("assumptions").alias("assumptions"))


@query(_LOG + """ SELECT count(*)::BIGINT AS n, CASE WHEN coalesce(seen, soft, fold.why) IS NULL THEN 'refused' WHEN seen IS NOT NULL THEN 'skipped' ELSE 'error' END AS outcome
FROM judged j LEFT JOIN fold ON fold.op_id = j.op_id AND j.seen IS NULL GROUP BY 2""")
def review_refusal(spark, d):
    """The same log with nothing skipped: one error refuses the whole."""
    rules, ops, applied = _log(spark, d)
    return V.replay(rules, ops, applied, NOW).report.groupBy("outcome").agg(F.count("*").alias("n"))
