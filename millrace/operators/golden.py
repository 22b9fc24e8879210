"""Golden spans: anchoring, span operations, sweeps, lint, proposals, consensus of two drafts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions import udfs


GRAMS = (32, 8, 1)  #: lengths of the quotes' heads by which a page is searched


def places(texts: list[str | None], quotes: set[str]) -> dict[str, list[tuple[int, int]]]:
    """All occurrences of each quote, overlapping ones too, as (index of the text, 0-based start): one walk over the texts for each length of heads."""
    found: dict[str, list[tuple[int, int]]] = {q: [] for q in quotes}
    at_least = {q: next(g for g in GRAMS if len(q) >= g) for q in quotes if q}
    for g in set(at_least.values()):
        heads: dict[str, list[str]] = {}
        for q in at_least:
            if at_least[q] == g:
                heads.setdefault(q[:g], []).append(q)
        for k, text in enumerate(texts):
            for i in range(len(text or "") - g + 1):
                for q in heads.get(text[i : i + g], ()):
                    if text.startswith(q, i):
                        found[q].append((k, i))
    return found


def _search(spans: pa.Table, blocks: pa.Table) -> pa.Table:
    """(span_id, block_id, start, how) of one page's spans."""
    ids, paths, texts = (blocks.column(c).to_pylist() for c in ("block_id", "path", "text"))
    own: dict = {}
    for k, i in enumerate(ids):
        own.setdefault(i, []).append(texts[k])
    out, open_ = [], []
    for s in spans.to_pylist():
        start, quote, block = s["start"], s["quote"], s["block_id"]
        for text in own.get(block, [None]) if block is not None else [None]:
            if None not in (text, start, quote) and start >= 0 and text.startswith(quote, start):
                out.append((s["span_id"], block, start, "exact"))
            else:
                open_.append(s)
    hits = places(texts, {s["quote"] for s in open_ if s["quote"]})
    known: dict[tuple, tuple] = {}
    for s in open_:
        quote, path, prefix, suffix = s["quote"], s["path"], s["prefix"], s["suffix"]
        key = (quote, None if path is None else tuple(path), prefix, suffix)
        if key not in known:
            every = hits.get(quote, [])
            here = []
            if prefix is not None and suffix is not None:
                here = [(k, i) for k, i in every if paths[k] == path and i >= len(prefix) and texts[k].startswith(prefix, i - len(prefix)) and texts[k].startswith(suffix, i + len(quote))]
            one, how = (here, "context") if len(here) == 1 else (every, "page") if len(every) == 1 else ([], "lost")
            known[key] = (ids[one[0][0]], one[0][1], how) if one else (None, None, how)
        out.append((s["span_id"], *known[key]))
    types = (spans.schema.field("span_id").type, blocks.schema.field("block_id").type, pa.int32(), pa.string())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["span_id", "block_id", "start", "how"])


def resolve(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(span_id, block_id, start, how): where each span stands now.

    A span whose block still holds its quote at its place is 'exact'. Otherwise the quote is looked for under the same
    heading path, with its context, and then on the page; only a single hit counts. 'lost' spans have no place.
    A page is searched in one task, in time that grows with its length and its hits, not with blocks times spans.
    spans: span_id, page, block_id, path, start, quote, prefix, suffix; blocks: page, block_id, path, text.
    """
    types = {f.name: f.dataType for f in [*spans.schema, *blocks.schema]}
    schema = T.StructType([T.StructField("span_id", types["span_id"]), T.StructField("block_id", types["block_id"]), T.StructField("start", T.IntegerType()), T.StructField("how", T.StringType())])
    wanted = spans.select("span_id", "page", "block_id", "path", "start", "quote", "prefix", "suffix").groupBy("page")
    return wanted.cogroup(blocks.where("page IS NOT NULL").select("page", "block_id", "path", "text").groupBy("page")).applyInArrow(_search, schema)


def folded(ops: DataFrame) -> DataFrame:
    """Spans after all operations: the last one of each span wins, and a deleted parent takes its children along.

    A child whose parent no operation names stays, so that orphans() can refuse it.

    ops: op_id, at, op ('span' or 'span_del'), span_id, of, body.
    """
    last = ops.withColumn("n", F.row_number().over(Window.partitionBy("span_id").orderBy(F.col("at").desc(), F.col("op_id").desc()))).where("n = 1 AND op = 'span'").drop("n")
    parents = last.where("of IS NULL").select(F.col("span_id").alias("of"))
    gone = ops.select(F.col("span_id").alias("of")).distinct().join(parents, "of", "left_anti")
    children = last.where("of IS NOT NULL").join(gone, "of", "left_anti")
    return last.where("of IS NULL").unionByName(children.select(last.columns))


def orphans(spans: DataFrame) -> DataFrame:
    """(span_id, of): children of a span that isn't there; a golden set with any is refused."""
    parents = spans.where("of IS NULL").select(F.col("span_id").alias("of"))
    return spans.where("of IS NOT NULL").join(parents, "of", "left_anti").select("span_id", "of")


def sweep_errors(dropped: DataFrame, candidates: DataFrame, spans: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(page, uid): accepted or paired candidates of completed pages that are neither marked nor listed as dropped."""
    kept = candidates.where(F.col("status").isin("accepted", "amended") | F.col("paired"))
    kept = kept.join(sweeps.where("status = 'complete'").select("page"), "page", "left_semi")
    kept = kept.join(spans.select("page", F.col("seed_uid").alias("uid")), ["page", "uid"], "left_anti")
    return kept.join(dropped.select("page", "uid"), ["page", "uid"], "left_anti").select("page", "uid")


# What a number is, and words that forbid.
NUMBER = r"\b\d+\b"
FORBIDS = r"(?iU)^(?:don['’]t|do not|never|avoid)\b"


def lint(rules: DataFrame) -> DataFrame:
    """(uid, level, finding) by the checks of a kept rule. rules: uid, status, statement, body, clarity, modality, violation_condition, direction, preconditions.

    A threshold that stands in a condition of an unambiguous rule, but not in the page's words, was chosen. A permission
    can never be broken: that is said, and nothing else. Then: no condition, no direction, a direction that the wording
    contradicts, and a condition that repeats the rule.
    """
    told = X.normalise_statement(F.col("statement"))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    stated = numbers(F.concat_ws(" ", "statement", "body"))
    chosen = F.size(F.array_except(F.flatten(F.transform("preconditions", numbers)), stated)) > 0
    permission = F.col("modality").eqNullSafe("MAY")
    blank = lambda c: F.coalesce(X.strip(F.col(c)), F.lit("")) == ""
    forbids = F.col("statement").rlike(FORBIDS)
    instructs = F.coalesce(X.directive_cue(F.col("statement")).isin("imperative", "conditional"), F.lit(False))
    inverted = ((F.col("direction") == "presence") & instructs & ~forbids) | ((F.col("direction") == "absence") & forbids)
    found = lambda where, level, name: F.when(where, F.struct(F.lit(level).alias("level"), F.lit(name).alias("finding")))
    checks = F.array_compact(F.array(
        found((F.col("clarity") == "unambiguous") & chosen, "check", "chosen-threshold"), found(permission, "check", "permission-as-rule"),
        found(~permission & blank("violation_condition"), "fix", "no-violation-condition"), found(~permission & blank("direction"), "fix", "no-direction"),
        found(~permission & inverted, "check", "direction-looks-inverted"), found(~permission & F.exists("preconditions", lambda p: X.normalise_statement(p) == told), "check", "precondition-restates-rule"),
    ))
    kept = rules.where(F.col("status").isin("accepted", "amended"))
    return kept.select("uid", F.explode(checks).alias("c")).select("uid", "c.*")


def unswept(rules: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(page): pages with marked rules that no one has completed; nothing can be measured there."""
    return rules.select("page").distinct().join(sweeps.where("status = 'complete'").select("page"), "page", "left_anti")


def nearest_labels(blocks: DataFrame, key: str = "page", order: str = "ord", labels: tuple[str, ...] = X.POSITIVE_LABELS + X.NEGATIVE_LABELS + X.NEUTRAL_LABELS) -> DataFrame:
    """Adds label: the last one up to a block, be it a heading or a paragraph; a heading that is none ends its reach."""
    said = F.lower(X.strip(F.col("plain")))
    mark = F.when(said.isin(*labels), said).when(F.col("kind") == "heading", "")
    seen = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("label", F.coalesce(F.last(mark, ignorenulls=True).over(seen), F.lit("")))


def example_polarity(examples: DataFrame, labelled: DataFrame) -> DataFrame:
    """(span_id, level, label): examples whose kind the page's own label contradicts, or that the page shows as neutral.

    examples: span_id, page, block_id, kind; labelled: page, block_id, label.
    """
    rows = examples.join(labelled.select("page", "block_id", "label"), ["page", "block_id"])
    wrong = ((F.col("kind") == "violating") & F.col("label").isin(*X.POSITIVE_LABELS)) | ((F.col("kind") == "compliant") & F.col("label").isin(*X.NEGATIVE_LABELS))
    level = F.when(wrong, "fix").when((F.col("kind") == "violating") & F.col("label").isin(*X.NEUTRAL_LABELS), "check")
    return rows.select("span_id", level.alias("level"), "label").where("level IS NOT NULL")


def unused_labelled(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(page, path, blocks): example blocks under a label of right or wrong that no span uses. blocks: page, block_id, path, example, label."""
    own = blocks.where(F.col("example") & F.col("label").isin(*X.POSITIVE_LABELS, *X.NEGATIVE_LABELS))
    return own.join(spans.select("page", "block_id").distinct(), ["page", "block_id"], "left_anti").groupBy("page", "path").agg(F.count("*").alias("blocks"))


def unmarked_directives(sentences: DataFrame, spans: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, block_id, start, text, owner): instructions that nothing accounts for, with the marked heading rule they stand under, if any.

    sentences: page, block_id, path, start, end, text (instructions outside examples); spans: page, block_id, start, end;
    rules: page, uid, path, statement, specification, preconditions, heading (whether the rule is its heading).
    """
    s, t = sentences.alias("s"), spans.alias("t")
    over = (F.col("s.page") == F.col("t.page")) & (F.col("s.block_id") == F.col("t.block_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end"))
    loose = s.join(t, over, "left_anti")
    words = F.concat_ws(" ", X.normalise_statement(F.col("specification")), F.transform("preconditions", X.normalise_statement), X.normalise_statement(F.col("statement")))
    told = rules.groupBy("page").agg(F.array_join(F.collect_list(words), " ").alias("told"))
    loose = loose.join(told, "page", "left")
    loose = loose.where(~F.coalesce(F.contains("told", F.rtrim(X.normalise_statement(F.col("text")), F.lit("."))), F.lit(False))).drop("told")
    # The owner is found by the prefixes of a sentence's path: an equi-join, not a comparison with every heading.
    prefixes = loose.select("page", "block_id", "start", "text", F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda n: F.slice("path", 1, n))).alias("k", "prefix"))
    heads = rules.where("heading").groupBy("page", F.col("path").alias("prefix")).agg(F.min("uid").alias("uid"))
    met = prefixes.join(heads, ["page", "prefix"], "left")
    return met.groupBy("page", "block_id", "start", "text").agg(F.max_by("uid", F.when(F.col("uid").isNotNull(), F.col("k"))).alias("owner"))


def resolved_pointers(pointers: DataFrame, blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds start and refused: no such block, quote not found, quote not unique, page title, or duplicate; null where it holds.

    pointers: page, ord, block_id, quote; blocks: page, block_id, plain; titles: page, title.
    """
    rows = pointers.join(blocks.select("page", "block_id", "plain"), ["page", "block_id"], "left").join(titles, "page", "left")
    # as it stands, or else with typography folded, which moves nothing
    exact = F.position(F.col("quote"), F.col("plain")) > 0
    plain, quote = (F.when(exact, F.col(c)).otherwise(X.plain_type(F.col(c))) for c in ("plain", "quote"))
    at = F.position(quote, plain)
    more = F.position(quote, plain, (at + 1).cast("int"))
    first = F.row_number().over(Window.partitionBy("page", "block_id", "quote").orderBy("ord"))
    why = (
        F.when(F.col("plain").isNull(), "no such block").when((F.coalesce(F.col("quote"), F.lit("")) == "") | (at == 0), "quote not found").when(more > 0, "quote not unique")
        .when(X.normalise_statement(F.col("quote")) == X.normalise_statement(F.col("title")), "page title").when(first > 1, "duplicate")
    )
    return rows.withColumn("refused", why).withColumn("start", F.when(F.col("refused").isNull(), at - 1)).drop("plain", "title")


def second_reading(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds verdict and settled: an item of one drafter that another family's reading calls a rule is taken. items: page, rid, kind; verdicts: page, rid, verdict."""
    rows = items.join(verdicts, ["page", "rid"], "left").withColumn("verdict", F.when(F.col("kind") == "single", F.col("verdict")))
    return rows.withColumn("settled", F.coalesce(F.col("verdict") == "rule", F.lit(False)))


def dropped_candidates(candidates: DataFrame, rules: DataFrame, scores: DataFrame) -> DataFrame:
    """(page, uid, rid): kept or paired candidates that no rule of the consensus marks; rid is the agreed rule that restates one, null for an item to decide.

    candidates: page, uid, status, paired; rules: page, rid, seed_uid, agreed; scores: page, uid, rid, score.
    """
    kept = candidates.where(~F.col("status").isin("rejected", "deferred") & (F.col("status").isin("accepted", "amended") | F.col("paired")))
    kept = kept.join(rules.where("seed_uid IS NOT NULL").select("page", F.col("seed_uid").alias("uid")), ["page", "uid"], "left_anti")
    best = scores.where("score > 0").join(rules.where("agreed").select("page", "rid"), ["page", "rid"]).groupBy("page", "uid").agg(F.max_by("rid", F.struct("score", "rid")).alias("rid"))
    return kept.join(best, ["page", "uid"], "left").select("page", "uid", "rid")


def check_examples(matchers: list[tuple[str, str, dict]], examples: DataFrame) -> DataFrame:
    """(rule_uid, missed, false_alarms): wrong examples that don't fire, right ones that do. examples: rule_uid, example, violating.

    An example is judged line by line, so a list's items are never matched across their joins.
    """
    lines = examples.withColumn("id", F.xxhash64("rule_uid", "example", "violating")).select("rule_uid", "id", F.explode(F.split("example", "\n")).alias("text"))
    hits = udfs.find_spans(lines.withColumnRenamed("rule_uid", "own"), matchers, keep=("own", "id"), own="own").select("id").distinct().withColumn("fired", F.lit(True))
    rows = examples.withColumn("id", F.xxhash64("rule_uid", "example", "violating")).join(hits, "id", "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    said = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("example"))))
    return rows.groupBy("rule_uid").agg(said(F.col("violating") & ~F.col("fired")).alias("missed"), said(~F.col("violating") & F.col("fired")).alias("false_alarms"))


def proposals(checks: DataFrame, measured: DataFrame) -> DataFrame:
    """Adds blockers and ready. checks: rule_uid, missed, false_alarms, n_compliant, n_violating, expected; measured: rule_uid, density."""
    rows = checks.join(measured, "rule_uid", "left").fillna(0.0, ["density"])
    blockers = F.array_compact(F.array(
        F.when(F.col("n_compliant") == 0, "no compliant example"), F.when(F.col("n_violating") == 0, "no violating example"),
        F.when(F.size("missed") > 0, "misses a violating example"), F.when(F.size("false_alarms") > 0, "fires on a compliant example"),
        F.when(F.col("density") > F.col("expected") + 1e-9, "denser than expected"),
    ))
    return rows.withColumn("blockers", blockers).withColumn("ready", F.size("blockers") == 0)


def plan(matched: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(page, i, j, outcome): agreed, single-a or single-b."""
    alone = lambda side, key: side.select("page", F.col("i").alias(key)).join(matched.select("page", key), ["page", key], "left_anti")
    return (
        matched.select("page", "i", "j", F.lit("agreed").alias("outcome"))
        .unionByName(alone(a, "i").withColumn("outcome", F.lit("single-a")), allowMissingColumns=True)
        .unionByName(alone(b, "j").withColumn("outcome", F.lit("single-b")), allowMissingColumns=True)
    )


def merged_examples(votes: DataFrame) -> DataFrame:
    """(page, extent, kind, how): both drafts agree, the manual's label backs one, or it stays an item to decide."""
    got = votes.groupBy("page", "extent").agg(F.collect_set("kind").alias("kinds"), F.count_distinct("drafter").alias("n"), F.max("label").alias("label"))
    agreed = (F.size("kinds") == 1) & (F.col("n") > 1)
    backed = F.array_contains("kinds", F.col("label"))
    return got.select("page", "extent", F.when(agreed, F.col("kinds")[0]).when(backed, F.col("label")).alias("kind"), F.when(agreed, "agreed").when(backed, "label").otherwise("item").alias("how"))


def exportable(rules: DataFrame, items: DataFrame, decided: DataFrame) -> DataFrame:
    """Rules of pages without an undecided item."""
    undecided = items.join(decided.select("item_id"), "item_id", "left_anti").select("page").distinct()
    return rules.join(undecided, "page", "left_anti")
