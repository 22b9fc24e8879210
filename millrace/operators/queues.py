"""What is left to do: pages that are settled, drafts that are complete, examples to judge; and matchers taken into the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scoring import touching


def human_pages(spans: DataFrame, machines: list[str]) -> DataFrame:
    """(page): pages with a span by anyone but the given authors. spans: page, by."""
    return spans.where(~F.coalesce(F.col("by").isin(*machines), F.lit(False))).select("page").distinct()


def settled_pages(spans: DataFrame, sweeps: DataFrame, machines: list[str]) -> DataFrame:
    """(page): pages that people marked, and those that a sweep by one of ``machines`` has completed. sweeps: page, status, by."""
    swept = sweeps.where((F.col("status") == "complete") & F.col("by").isin(*machines)).select("page")
    return human_pages(spans, machines).unionByName(swept).distinct()


def ready_pages(pages: DataFrame, drafted: DataFrame, settled: DataFrame, drafters: list[str]) -> DataFrame:
    """(page, missing): pages to plan that aren't settled, with the drafters that have not drafted them yet; none missing: ready."""
    have = drafted.where(F.col("drafter").isin(*drafters)).groupBy("page").agg(F.collect_set("drafter").alias("have"))
    rows = pages.select("page").distinct().join(settled.select("page"), "page", "left_anti").join(have, "page", "left")
    return rows.select("page", F.array_except(F.array(*map(F.lit, drafters)), F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))


def example_queue(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The items without a verdict. items: id and more; verdicts: id."""
    return items.join(verdicts.select("id"), "id", "left_anti")


def declined(singles: DataFrame, not_rules: DataFrame) -> DataFrame:
    """Adds other_said to rules of one drafter: what the other said about a text that shares characters with the rule, or ``nothing``.

    singles: page, rid, block, start, end; not_rules: page, n, block, start, end, reason, note. The first of several counts.
    """
    met = touching(singles.withColumn("at", F.col("rid")), not_rules.withColumn("at", F.struct("n", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("note", F.lit("")).alias("note"))), ["page", "block"], ["at"])
    first = met.groupBy("page", F.col("a_at").alias("rid")).agg(F.min("b_at").alias("m"))
    said = F.rtrim(F.concat(F.lit("not a rule: "), "m.reason", F.lit(" "), "m.note"))
    return singles.join(first.select("page", "rid", said.alias("other_said")), ["page", "rid"], "left").withColumn("other_said", F.coalesce("other_said", F.lit("nothing")))


def adopted(rules: DataFrame, checks: DataFrame, wanted: DataFrame, by: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(rules, report): rules with the matchers of ready proposals, and for each uid asked for what became of it.

    rules: uid, status, detectable, tier, method, matcher, not_detectable_reason, examples_pass, density, expected, history;
    checks: uid, ready, blockers, method, matcher, density, expected, origin; wanted: uid. The status stays; the history
    tells who took the matcher over, and from where. A proposal for a uid without a rule is told and not taken.
    """
    asked = wanted.select("uid").distinct().join(checks, "uid", "left").join(rules.select("uid", F.lit(True).alias("__rule")), "uid", "left")
    why = F.when(F.col("ready").isNull(), "no proposal").when(F.col("__rule").isNull(), "no rule").when(~F.col("ready"), F.concat(F.lit("blocked: "), F.array_join("blockers", "; ")))
    report = asked.select("uid", F.coalesce(why, F.lit("adopted")).alias("outcome"))
    new = asked.where(why.isNull()).select("uid", F.col("method").alias("__method"), F.col("matcher").alias("__matcher"), F.round("density", 4).alias("__density"), F.coalesce("expected", F.lit(0.0)).alias("__expected"), F.coalesce("origin", F.lit("a proposal")).alias("__origin"))
    rows = rules.join(new, "uid", "left")
    taken = F.col("__method").isNotNull()
    entry = F.struct(F.col("status").alias("from"), F.col("status").alias("to"), F.lit(by).alias("by"), F.lit(now).alias("at"), F.concat(F.lit("adopted Tier 0 matcher from "), "__origin").alias("note"))
    kind = rules.schema["history"].dataType
    change: dict[str, Column] = {
        "detectable": F.lit(True), "tier": F.lit(0), "method": F.col("__method"), "matcher": F.col("__matcher"), "not_detectable_reason": F.lit(""), "examples_pass": F.lit(True),
        "density": F.col("__density"), "expected": F.col("__expected"), "history": F.concat(F.coalesce("history", F.array().cast(kind)), F.array(entry).cast(kind)),
    }
    return rows.select("uid", "status", *[F.when(taken, v).otherwise(F.col(c)).alias(c) for c, v in change.items()]), report
