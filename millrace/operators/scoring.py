"""Scores of drafted rules against marked ones, and of what several drafters agree on.

A rule is a span: page, i, block, start, end, quote, tags (a map). An example is a span of a rule: page, i, block, start,
end, quote, kind. Tables of drafts have a column drafter before these. Two rules are the same, in falling strength, if
their spans overlap (3 and the common characters), if one is a heading and the other the prose right below it (2 and the
likeness of their words), if they have examples in common (1.5 and a hundredth for each, 49 at most), or if they stand in
one section with at least half of their words in common (the likeness). A page's rules are matched in one worker, which
finds each kind by its own index: by block, by heading path, by example and by rare words.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators import evaluate as E
from millrace.session import written

# Titles that label examples, and the tags that are compared.
LABELS = ("example", "examples", "correct", "incorrect", "write this", "not this")
TAGS = ("direction", "modality", "unit", "detection_hint")
PLAN_TAGS = ("direction", "modality", "unit", "detection_hint", "clarity", "applies_to")
LIKE = 0.5


def placed(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds heading and path of each rule's block. blocks: page, block, kind, path. A rule in an unknown block has neither."""
    known = blocks.select("page", "block", (F.col("kind") == "heading").alias("heading"), "path")
    return rules.join(known, ["page", "block"], "left")


def touching(a: DataFrame, b: DataFrame, keys: list[str], at: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys and the columns ``at``, as a_... and b_..., overlap): spans of two tables that share characters.

    Bins are as wide as the key's mean span; a pair is given in the first bin that both have.
    """
    spans = [t.where(F.col(end) > F.col(start)) for t in (a, b)]
    width = spans[0].select(*keys, (F.col(end) - F.col(start)).alias("n")).unionByName(spans[1].select(*keys, (F.col(end) - F.col(start)).alias("n")))
    width = width.groupBy(*keys).agg(F.ceil(F.avg("n")).alias("w"))

    def binned(t: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col(start) / F.col("w")), F.floor((F.col(end) - 1) / F.col("w"))
        return t.join(width, keys).select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in at], F.col(start).alias(f"{side}0"), F.col(end).alias(f"{side}1"), first.alias(f"{side}_bin"), F.explode(F.sequence(first, last)).alias("bin"))

    met = binned(spans[0], "a").join(binned(spans[1], "b"), [*keys, "bin"])
    overlap = F.least("a1", "b1") - F.greatest("a0", "b0")
    met = met.where((F.col("bin") == F.greatest("a_bin", "b_bin")) & (overlap > 0))
    return met.select(*keys, *[f"{s}_{c}" for s in "ab" for c in at], overlap.alias("overlap"))


class Rule:
    """A rule on its page. path: a tuple, None for a rule in an unknown block; examples: their extents."""

    __slots__ = ("i", "block", "start", "end", "quote", "heading", "path", "examples", "_words")

    def __init__(self, i, block, start, end, quote, heading, path, examples=()):
        self.i, self.block, self.start, self.end, self.quote, self.heading, self.path, self.examples = i, block, start, end, quote, heading, path, examples
        self._words = None

    @property
    def words(self) -> frozenset:
        """X.tokens_long of the quote."""
        if self._words is None:
            self._words = frozenset(w for w in _WORD.findall((self.quote or "").lower()) if len(w) > 2)
        return self._words


_WORD = re.compile("[a-z]+")
_FEW = 64  #: so many pairs of a page are compared without an index


def _like(x: Rule, y: Rule) -> float:
    both = len(x.words & y.words)
    return both / (len(x.words) + len(y.words) - both) if both else 0.0


def _worded(a: list[Rule], b: list[Rule]) -> Iterator[tuple[Rule, Rule]]:
    """Pairs that may have half of their words in common: all of a few, else those that share one of the rarest words of both."""
    if len(a) * len(b) <= _FEW:
        yield from ((x, y) for x in a for y in b)
        return
    n = Counter(w for r in chain(a, b) for w in r.words)

    def first(r: Rule) -> list[str]:
        return sorted(r.words, key=lambda w: (n[w], w))[: len(r.words) - math.ceil(len(r.words) * LIKE) + 1]

    at = defaultdict(list)
    for y in b:
        for w in first(y) if y.words else ():
            at[w].append(y)
    for x in a:
        near = {id(y): y for w in (first(x) if x.words else ()) for y in at.get(w, ())}
        yield from ((x, y) for y in near.values())


def likenesses(a: list[Rule], b: list[Rule]) -> dict[tuple, float]:
    """(i, j): score, of the pairs of one page's rules that may be one rule; see above."""
    met: dict[tuple, float] = {}
    a, b = ([r for r in rules if r.path is not None] for rules in (a, b))

    def put(x: Rule, y: Rule, score: float) -> None:
        if score > met.get((x.i, y.i), 0):
            met[x.i, y.i] = score

    said = defaultdict(list)
    for y in sorted((y for y in b if y.start is not None and y.end is not None), key=lambda y: y.start):
        said[y.block].append(y)
    for x in a:
        for y in said.get(x.block, ()) if x.start is not None and x.end is not None else ():
            if y.start >= x.end:
                break
            if (over := min(x.end, y.end) - max(x.start, y.start)) > 0:
                put(x, y, 3.0 + over)
    for heads, prose, turned in ((a, b, False), (b, a, True)):
        below = defaultdict(list)
        for p in prose:
            if p.heading is False:
                below[p.path].append(p)
                if p.path and (p.path[-1] or "").strip().lower() in LABELS:
                    below[p.path[:-1]].append(p)
        for h in heads:
            for p in below.get(h.path, ()) if h.heading else ():
                put(*((p, h) if turned else (h, p)), 2 + _like(h, p))
    shown = defaultdict(list)
    for y in b:
        for e in set(y.examples):
            shown[e].append(y)
    for x in a:
        common = Counter(y for e in set(x.examples) for y in shown.get(e, ()))
        for y, n in common.items():
            put(x, y, 1.5 + min(n, 49) / 100)
    for x, y in _worded(a, b):
        n = min(len(x.path), len(y.path))
        # what is scored already has more than words can give
        if n and x.path[:n] == y.path[:n] and (x.i, y.i) not in met and (like := _like(x, y)) >= LIKE:
            met[x.i, y.i] = like
    return met


def one_to_one(met: dict[tuple, float]) -> list[tuple]:
    """(i, j, score): the strongest pairs first, so a weak match never takes a rule that a strong one needs."""
    left, right, out = set(), set(), []
    for (i, j), score in sorted(met.items(), key=lambda m: (-m[1], *m[0])):
        if i not in left and j not in right:
            left.add(i), right.add(j), out.append((i, j, score))
    return out


def _paged(a: DataFrame, b: DataFrame, a_examples: DataFrame, b_examples: DataFrame, by: list[str], greedy: bool) -> DataFrame:
    """Rules and examples meet once, dealt by page and sorted; a worker holds one page's."""
    own, extent = ["quote", "heading", "path"], ["i", "block", "start", "end"]
    none = [F.lit(None).cast(a.schema[c].dataType).alias(c) for c in own]
    rows = [t.select(*by, F.lit(k).alias("what"), *extent, *own) for k, t in ((2, a), (3, b))] + [t.select(*by, F.lit(k).alias("what"), *extent, *none) for k, t in ((0, a_examples), (1, b_examples))]
    rows = functools.reduce(DataFrame.unionByName, rows).dropna(subset=by).repartition(*by).sortWithinPartitions(*by, "what")
    out = T.StructType([*[a.schema[c] for c in by], T.StructField("i", a.schema["i"].dataType), T.StructField("j", b.schema["i"].dataType), T.StructField("score", T.DoubleType())])
    schema, n = to_arrow_schema(out), len(by)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, page in groupby(each, lambda r: r[:n]):
            kids, sides = (defaultdict(list), defaultdict(list)), ([], [])
            for what, i, *extent, quote, heading, path in (r[n:] for r in page):
                if what < 2:
                    kids[what][i] += [tuple(extent)] * (None not in extent)
                else:
                    sides[what - 2].append(Rule(i, *extent, quote, heading, None if path is None else tuple(path), kids[what - 2].get(i, ())))
            met = likenesses(*sides)
            found = one_to_one(met) if greedy else [(*m, s) for m, s in met.items()]
            columns = [[v] * len(found) for v in key] + [[f[k] for f in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(match, out)


def alike(a: DataFrame, b: DataFrame, a_examples: DataFrame, b_examples: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, score): pairs of rules of ``a`` and ``b`` that may be one rule. Both are placed()."""
    return _paged(a, b, a_examples, b_examples, by, False)


def matched(a: DataFrame, b: DataFrame, a_examples: DataFrame, b_examples: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, score): one-to-one, the strongest pairs first."""
    return _paged(a, b, a_examples, b_examples, by, True)


COUNTS = (
    "golden", "drafted", "matched", "exact_extent", "refused", "examples_golden", "examples_found", "conflicts",
    "accepted", "added", "walk_hits", "walk_candidates", "regex_hits", "regex_candidates",
)


class Scored:
    """Drafts against the rules that people marked.

    golden: rules, with seeded (it was taken from the draft on screen); drafted: drafter, page, refused, one row a draft;
    pages: page, blind, swept; walk: page, block of heading candidates; directives: page, block, start, end of sentences.
    Drafts of pages without any mark are left out.
    """

    def __init__(self, golden: DataFrame, golden_examples: DataFrame, drafted: DataFrame, drafts: DataFrame, draft_examples: DataFrame, blocks: DataFrame, pages: DataFrame, walk: DataFrame, directives: DataFrame):
        self.by = by = ["drafter", "page"]
        marked = golden.select("page").unionByName(golden_examples.select("page")).distinct()
        self.drafted = drafted.join(marked, "page", "left_semi").join(pages.select("page", "blind", "swept"), "page", "left").fillna(False, ["blind", "swept"])
        who = self.drafted.select(*by)
        self.golden = written(who.join(placed(golden, blocks), "page"))
        self.drafts = written(placed(drafts, blocks).join(who, by, "left_semi"))
        self.mine = who.join(golden_examples, "page")
        self.theirs = draft_examples.join(who, by, "left_semi")
        self.pairs = written(matched(self.golden, self.drafts, self.mine, self.theirs, by))
        self.walk, self.directives, self.who = walk.select("page", "block").distinct(), directives, who

    def _sides(self, *columns: str) -> DataFrame:
        for_side = lambda t, key, side: t.select(*self.by, F.col("i").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        return self.pairs.join(for_side(self.golden, "i", "g"), [*self.by, "i"]).join(for_side(self.drafts, "j", "d"), [*self.by, "j"])

    def examples(self) -> DataFrame:
        """(drafter, page, i, quote, human, draft) for each example of a matched rule; draft is null where the draft lacks it. A quote counts once a rule, its last kind."""
        last = lambda t, key, kind: t.groupBy(*self.by, F.col("i").alias(key), "quote").agg(F.max_by("kind", F.struct("ord", "kind")).alias(kind))
        mine = self.pairs.join(last(self.mine, "i", "human"), [*self.by, "i"])
        return mine.join(last(self.theirs, "j", "draft"), [*self.by, "j", "quote"], "left").select(*self.by, "i", "j", "quote", "human", "draft")

    def tags(self) -> DataFrame:
        """(drafter, page, tag, agree, compared) over matched rules whose mark has the tag."""
        rows = self._sides("tags").select(*self.by, F.explode(F.array(*map(F.lit, TAGS))).alias("tag"), "g_tags", "d_tags")
        human = F.coalesce(F.try_element_at("g_tags", F.col("tag")), F.lit(""))
        rows = rows.where(human != "").groupBy(*self.by, "tag")
        return rows.agg(F.count_if(human.eqNullSafe(F.try_element_at("d_tags", F.col("tag")))).alias("agree"), F.count("*").alias("compared"))

    def unmatched(self) -> DataFrame:
        """(drafter, page, side, i, quote): what the draft missed and what it has alone, the first 120 characters."""
        missed = self.golden.join(self.pairs.select(*self.by, "i"), [*self.by, "i"], "left_anti").withColumn("side", F.lit("missed"))
        extra = self.drafts.join(self.pairs.select(*self.by, F.col("j").alias("i")), [*self.by, "i"], "left_anti").withColumn("side", F.lit("extra"))
        return missed.select(*self.by, "side", "i", "quote").unionByName(extra.select(*self.by, "side", "i", "quote")).withColumn("quote", F.left("quote", F.lit(120)))

    def pages(self) -> DataFrame:
        """(drafter, page, blind, swept and COUNTS), one row a draft. All counts meet in one aggregate, summed map-side."""
        by = self.by
        same = (F.col("g_block") == F.col("d_block")) & (F.col("g_start") == F.col("d_start")) & (F.col("g_end") == F.col("d_end"))
        hit = self.golden.join(self.walk, ["page", "block"], "left_semi")
        spans = self.golden.select("page", "block", "i", "start", "end").distinct()
        said = touching(spans, self.directives.withColumn("i", F.lit(0)), ["page", "block"], ["i"]).select("page", F.col("a_i").alias("i")).distinct()
        one = F.lit(1)
        parts: list[tuple[DataFrame, dict[str, Column]]] = [
            (self.drafted, {"refused": F.col("refused")}),
            (self.golden.join(self.drafted.select(*by, "blind"), by), {"golden": one, "accepted": (F.col("seeded") & ~F.col("blind")).cast("int"), "added": (~F.col("seeded") & ~F.col("blind")).cast("int")}),
            (self.drafts, {"drafted": one}),
            (self._sides("block", "start", "end"), {"matched": one, "exact_extent": same.cast("int")}),
            (self.examples(), {"examples_golden": one, "examples_found": F.col("draft").isNotNull().cast("int"), "conflicts": F.coalesce(F.col("draft") != F.col("human"), F.lit(False)).cast("int")}),
            (hit, {"walk_hits": one}), (self.who.join(self.walk, "page"), {"walk_candidates": one}),
            (self.who.join(said, "page"), {"regex_hits": one}), (self.who.join(self.directives, "page"), {"regex_candidates": one}),
        ]
        rows = [t.select(*by, *[v.cast("long").alias(k) for k, v in counts.items()]) for t, counts in parts]
        summed = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
        return self.drafted.select(*by, "blind", "swept").join(summed, by)


def totals(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, stratum, pages, COUNTS and shares): one row for each combination and for all ("*"), blind and seeded pages apart.

    Blind pages measure quality: recall, precision over swept pages, exact extents, examples and the two baselines. Seeded
    pages had the draft on screen, so they tell what was accepted and never quality. A share without a base is null.
    """
    by = ["drafter"] if by is None else by
    swept = {f"{c}_swept": F.sum(F.when(F.col("swept"), F.col(c)).otherwise(0)) for c in ("matched", "drafted")}
    cubed = pages.withColumn("stratum", F.when(F.col("blind"), "blind").otherwise("seeded")).groupingSets([[*some, "stratum"] for some in _subsets(by)], *by, "stratum")
    got = cubed.agg(F.count("*").alias("pages"), F.count_if("swept").alias("swept_pages"), *[F.sum(c).alias(c) for c in COUNTS], *[v.alias(k) for k, v in swept.items()], *[F.grouping(b).alias(f"__{b}") for b in by])
    blind = F.col("stratum") == "blind"
    share = lambda when, n, of: F.when(when & (F.col(of) > 0), F.round(F.col(n) / F.col(of), 6))
    return got.select(
        *[F.when(F.col(f"__{b}") == 1, "*").otherwise(F.col(b).cast("string")).alias(b) for b in by], "stratum", "pages", "swept_pages", *COUNTS,
        share(blind, "matched", "golden").alias("recall"), share(blind, "matched_swept", "drafted_swept").alias("precision"), share(blind, "exact_extent", "matched").alias("exact"),
        share(F.lit(True), "examples_found", "examples_golden").alias("examples"), share(blind, "walk_hits", "golden").alias("walk_recall"), share(blind, "regex_hits", "golden").alias("regex_recall"),
        share(~blind, "accepted", "golden").alias("acceptance"),
    )


def _subsets(by: list[str]) -> list[list[str]]:
    return [[b for k, b in enumerate(by) if n >> k & 1] for n in range(1 << len(by))]


def settled(rows: DataFrame) -> DataFrame:
    """Adds at (the side whose extent counts), anchor_from, tags and open to pairs of rules in_a and in_b: block, start, end, quote, tags, seed_uid."""
    same = (F.col("in_a.block") == F.col("in_b.block")) & (F.col("in_a.start") == F.col("in_b.start")) & (F.col("in_a.end") == F.col("in_b.end"))
    size = lambda s: F.col(f"in_{s}.end") - F.col(f"in_{s}.start")
    source = (
        F.when(same, "both").when((F.col("in_a.seed_uid") != "") & (F.col("in_b.seed_uid") == ""), "a").when((F.col("in_b.seed_uid") != "") & (F.col("in_a.seed_uid") == ""), "b")
        .when(size("a") <= size("b"), "a").otherwise("b")
    )
    rows = rows.withColumn("anchor_from", source).withColumn("at", F.when(F.col("anchor_from") == "b", F.col("in_b")).otherwise(F.col("in_a")))
    said = lambda s, tag: F.coalesce(F.try_element_at(f"in_{s}.tags", F.lit(tag)), F.lit("any" if tag == "applies_to" else ""))
    settled = {
        "modality": E.settle_modality(F.col("at.quote"), said("a", "modality"), said("b", "modality")), "unit": E.settle_order(said("a", "unit"), said("b", "unit"), E.UNITS),
        "clarity": E.settle_order(said("a", "clarity"), said("b", "clarity"), E.CLARITY), "detection_hint": E.settle_hint(said("a", "detection_hint"), said("b", "detection_hint")),
    }
    value = {t: F.when(said("a", t) == said("b", t), said("a", t)).otherwise(F.nullif(settled.get(t, F.lit("")), F.lit(""))) for t in PLAN_TAGS}
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(t).alias("key"), v.alias("value")) for t, v in value.items()]), lambda e: e["value"].isNotNull()))
    unsettled = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(t)) for t, v in value.items()]))
    return rows.withColumn("tags", tags).withColumn("open", unsettled)


class Consensus:
    """What pairs of drafters of different families make of the pages that both drafted.

    drafted: drafter, page, refused; families: drafter, family, a short list. The drafter with the smaller name comes first,
    and its examples and tags lead. Pairs are pairs of drafters of one page: rules meet only by the joins of alike().
    """

    def __init__(self, drafted: DataFrame, drafts: DataFrame, examples: DataFrame, families: DataFrame, blocks: DataFrame):
        known = drafted.join(families, "drafter")
        a, b = (known.select("page", F.col("drafter").alias(s), F.col("family").alias(f"{s}_family")) for s in ("a", "b"))
        self.pairs = a.join(b, "page").where((F.col("a") < F.col("b")) & (F.col("a_family") != F.col("b_family"))).select("a", "b", "page")
        self.by = by = ["a", "b", "page"]
        at = placed(drafts, blocks)
        side = lambda t, s: self.pairs.join(t.withColumnRenamed("drafter", s), ["page", s])
        self.rules = {s: side(at, s) for s in "ab"}
        self.examples = {s: side(examples, s) for s in "ab"}
        self._agreed: DataFrame | None = None
        self.matched = written(matched(self.rules["a"], self.rules["b"], self.examples["a"], self.examples["b"], by))

    def _side(self, s: str, key: str) -> DataFrame:
        return self.rules[s].select(*self.by, F.col("i").alias(key), F.struct("block", "start", "end", "quote", "tags", F.coalesce("seed_uid", F.lit("")).alias("seed_uid")).alias(f"in_{s}"))

    def agreed(self) -> DataFrame:
        """(a, b, page, i, j, block, start, end, quote, anchor_from, tags, open): rules that both found.

        The extent is the common one, else that of a whole candidate heading, else the shorter, the first in a tie. Tags that
        differ are settled where a rule for it exists; ``open`` lists those that are not.
        """
        if self._agreed is not None:
            return self._agreed
        rows = self.matched.join(self._side("a", "i"), [*self.by, "i"]).join(self._side("b", "j"), [*self.by, "j"])
        self._agreed = written(settled(rows).select(*self.by, "i", "j", "at.block", "at.start", "at.end", "at.quote", "anchor_from", "tags", "open"))
        return self._agreed

    def single(self) -> DataFrame:
        """(a, b, page, i, j, block, start, end, quote, tags, anchor_from): rules that one of the two found."""
        out = []
        for s, key, other in (("a", "i", "j"), ("b", "j", "i")):
            alone = self._side(s, key).join(self.matched.select(*self.by, key), [*self.by, key], "left_anti")
            at = f"in_{s}"
            out.append(alone.select(*self.by, key, F.lit(None).cast("long").alias(other), f"{at}.block", f"{at}.start", f"{at}.end", f"{at}.quote", f"{at}.tags", F.lit(s).alias("anchor_from")))
        return out[0].unionByName(out[1])

    def proposed(self) -> tuple[DataFrame, DataFrame]:
        """Drafts of the scoring form, and their examples: drafter "a + b: agreed" has the common rules, "a + b: either" all.

        An example of an agreed rule is taken once, with the kind that the first drafter gives it.
        """
        whole = self.agreed().drop("open").withColumn("single", F.lit(False)).unionByName(self.single().withColumn("single", F.lit(True)))
        number = F.struct(F.coalesce("i", F.lit(-1)).cast("long").alias("i"), F.coalesce("j", F.lit(-1)).cast("long").alias("j"))
        whole = whole.withColumn("n", F.row_number().over(Window.partitionBy(*self.by).orderBy("single", number)).cast("long"))
        name = lambda kind: F.concat_ws("", F.col("a"), F.lit(" + "), F.col("b"), F.lit(f": {kind}"))
        each = F.explode(F.when(F.col("single"), F.array(name("either"))).otherwise(F.array(name("agreed"), name("either")))).alias("drafter")
        mine = self.examples["a"].select(*self.by, "i", "block", "start", "end", "quote", "kind", "ord", F.lit(0).alias("rank"))
        theirs = self.examples["b"].select(*self.by, F.col("i").alias("j"), "block", "start", "end", "quote", "kind", "ord", F.lit(1).alias("rank"))
        of = whole.select(*self.by, "i", "j", "n", each)
        of = of.join(mine, [*self.by, "i"]).drop("i", "j").unionByName(of.join(theirs, [*self.by, "j"]).drop("i", "j"))
        of = of.groupBy("drafter", "page", F.col("n").alias("i"), "block", "start", "end").agg(F.min_by(F.struct("quote", "kind", "ord"), F.struct("rank", "ord")).alias("e"))
        return written(whole.select(each, "page", F.col("n").alias("i"), "block", "start", "end", "quote", "tags")), written(of.select("drafter", "page", "i", "block", "start", "end", "e.*"))

    def items(self) -> DataFrame:
        """(a, b, page, singles, tag_items): what is left to decide on each page."""
        singles = self.single().groupBy(*self.by).agg(F.count("*").alias("singles"))
        tags = self.agreed().where(F.size("open") > 0).groupBy(*self.by).agg(F.count("*").alias("tag_items"))
        return self.pairs.join(singles, self.by, "left").join(tags, self.by, "left").fillna(0)

    def drafted(self) -> DataFrame:
        """(drafter, page, refused) of the proposed drafts, empty ones too."""
        name = lambda kind: F.concat_ws("", F.col("a"), F.lit(" + "), F.col("b"), F.lit(f": {kind}"))
        return self.pairs.select(F.explode(F.array(name("agreed"), name("either"))).alias("drafter"), "page", F.lit(0).cast("long").alias("refused"))


def grid(pages: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(by, pages, sums, recall): every cell of the grid and its margins, "*" for all, by one cube."""
    got = pages.cube(*by).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in sums], *[F.grouping(b).alias(f"__{b}") for b in by])
    recall = F.when(F.col("golden") > 0, F.round(F.col("matched") / F.col("golden"), 6))
    return got.select(*[F.when(F.col(f"__{b}") == 1, "*").otherwise(F.col(b).cast("string")).alias(b) for b in by], "pages", *sums, recall.alias("recall"))
