"""Mixing to target weights by soft membership, in DataFrame functions only.

The labelled table gives three domains: good (quality 1, not toxic), poor (quality 0, not toxic) and toxic. A naive
Bayes classifier over hashed words gives every document a posterior over them. One event model serves learning and
scoring: a hashed word, or a mark of the text's shape, occurs in a document or not. Learned by one aggregate over at most LABELLED labelled rows; a word
whose shares in two domains differ by less than SURE standard errors says nothing, and EVIDENCE telling words at most speak for
a document, so that a few toxic words are not drowned by many plain ones and posteriors stay soft where words disagree.

Rates r >= 0 a document are fitted so that the expected tokens of each domain, sum(r * tokens * posterior), meet its
target t: least squares on the misses m(r) = A r - t, with A(domain, document) = tokens * posterior. Projected gradient
from r = 1: the gradient of |m|^2 / 2 is A' m, in the metric of the documents' tokens the posterior times m. The step is
scaled by the domains' Gram matrix over the documents with a rate above zero (A times the move that a unit miss makes),
so a step meets the targets at once but for the rates it projects back to zero; of the step, parts of it and the plain
gradient the one that leaves the least squares is taken. It ends where m = 0, the least value
that the squares can have. A step needs a few numbers per domain from the cluster, and a rate follows from a document's
posterior and the steps so far, so a pass is one narrow aggregate and a handful of passes do.

The budget is set so that the domain ``whole`` keeps all its tokens (times SLACK); the others are thinned or repeated:
a document at rate r is taken floor(r) times, and once more by one draw on the fraction, so that rates above 1 take effect.
fit() warns with the domains' misses where its passes run out before the targets are met.

Defined results: null text has no words, no tokens and the prior as posterior; labels that are null are left out,
repeated ones count once as the smallest, and of rows that share a labelled id one is learned from; without labels the
posterior is uniform; domains without tokens are left out of the fit; repeated rows stay; an empty table gives no rows;
posteriors() passes further columns on and refuses an input that already has a column of a name it adds.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _stats
from millrace.llm._spark import Shelf

LABELLED = 12_000  #: bound of the labelled rows learned from
BUCKETS = 1 << 14
EVIDENCE, SMOOTH, SURE = 60, 0.5, 4.0
FLOOR = 0.05  #: posteriors below it count as none
STEPS, CLOSE, SLACK = 24, 1e-3, 1.02
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.94, "poor": 0.02, "toxic": 0.04}
ADDED = ("n_tokens", *[f"p_{d}" for d in DOMAINS])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(F.lower(word)), F.lit(BUCKETS))


def _events(words: Column, text: Column) -> Column:
    """The distinct hashed words of a text, and its shape: length, share of distinct words, characters a word, share of signs."""
    n, many = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(F.coalesce(text, F.lit("")))
    signs = chars - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[#*$%&|<>{}\[\]\\^~=_+/@!?]", ""))
    shape = [F.floor(F.log2(n + 1)), F.floor(20 * many / (n + 1)), F.floor(chars / (n + 1)), F.floor(4 * F.log2(1 + 1000 * signs / (chars + 1)))]
    said = F.array(*[F.pmod(F.hash(F.lit(k), v), F.lit(BUCKETS)) for k, v in enumerate(shape)])
    return F.array_distinct(F.concat(words, F.when(n > 0, said).otherwise(F.slice(said, 1, 0))))


@dataclass
class Model:
    prior: np.ndarray  # log, by domain
    odds: np.ndarray  # by domain and bucket: what its presence adds to the log odds against the first domain
    silence: np.ndarray  # by domain: the log odds of a text of ``events`` events without any telling word
    events: float  # events of a text, in the mean


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """What at most ``bound`` labelled rows say of the domains."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    y = y.groupBy("doc_id").agg(F.min(F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)).alias("k"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    said = _stats.one_text(docs, y)  # at most `bound` rows
    words = said.select("k", F.explode(F.concat(F.array(F.lit(-1)), _events(F.transform(_words(F.col("text")), _bucket), F.col("text")))).alias("b"))
    seen, many = np.zeros((len(DOMAINS), BUCKETS)), np.zeros((len(DOMAINS), 1))
    for r in words.groupBy("k", "b").count().collect():  # at most domains x (BUCKETS + 1)
        (many if r["b"] < 0 else seen)[r["k"], max(0, r["b"])] += r["count"]
    prior = np.log((many[:, 0] + 1) / (many + 1).sum())
    share = (seen + SMOOTH) / (many + 2 * SMOOTH)
    pooled = (seen + seen[:1] + SMOOTH) / (many + many[:1] + 2 * SMOOTH)
    error = np.sqrt(pooled * (1 - pooled) * (1 / np.maximum(many, 1) + 1 / np.maximum(many[:1], 1)))
    sure = min(SURE, max(0.0, 1.6 * (np.log10(max(1.0, many.sum())) - 1)))  # fewer rows, fewer words to err on
    found = seen / np.maximum(many, 1)
    tells = np.abs(found - found[:1]) > sure * error  # a word that neither holds tells nothing
    said = np.where(tells, np.log(share) - np.log(share[:1]), 0.0)
    silent = np.where(tells & (share > share[:1]), np.log1p(-share) - np.log1p(-share[:1]), 0.0)
    return Model(prior, said - silent, silent.sum(1), max(1.0, float(seen.sum() / max(1.0, many.sum()))))


def posteriors(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens (words) and p_good, p_poor, p_toxic."""
    if clash := [c for c in ADDED if c in df.columns]:
        raise ValueError(f"the input already has columns {clash}")
    prior, odds = model.prior, model.odds
    telling = np.flatnonzero((odds != 0).any(0))
    place = np.zeros(BUCKETS, np.int32)
    place[telling] = np.arange(1, len(telling) + 1)
    own, words, events = "__buckets", "__words", "__events"
    out = df.withColumn(words, F.transform(_words(F.col(text)), _bucket)).withColumn("n_tokens", F.size(words).cast("long"))
    out = out.withColumn(events, _events(F.col(words), F.col(text)))
    out = out.withColumn(own, F.filter(F.transform(events, lambda b: F.get(F.lit(place), b)), lambda at: at > 0))
    heard = F.least(F.lit(1.0), F.size(events) / model.events)  # a short text is silent about less
    weight = EVIDENCE / F.greatest(F.size(own), F.lit(EVIDENCE)).cast("double")
    added = []
    for k in range(1, len(DOMAINS)):
        table = F.lit(np.concatenate([[0.0], np.round(odds[k][telling], 6)]))
        total = F.aggregate(own, F.lit(0.0), lambda sum_, at: sum_ + F.get(table, at))  # noqa: B023
        out = out.withColumn(f"__o{k}", F.greatest(F.least(total * weight + heard * float(model.silence[k]) + float(prior[k] - prior[0]), F.lit(60.0)), F.lit(-60.0)))
        added.append(F.exp(F.col(f"__o{k}")))
    whole = sum(added, F.lit(1.0))
    raw = [F.col(f"__p{k}") for k in range(len(DOMAINS))]
    for k, part in enumerate([F.lit(1.0), *added]):
        out = out.withColumn(f"__p{k}", F.when(part / whole >= FLOOR, part / whole).otherwise(0.0))
    for d, part in zip(DOMAINS, raw, strict=True):
        out = out.withColumn(f"p_{d}", part / sum(raw, F.lit(0.0)))
    out = out.drop(*[f"__p{k}" for k in range(len(DOMAINS))])
    return out.drop(own, words, events, *[f"__o{k}" for k in range(1, len(DOMAINS))])


def rate(steps: list[list[float]]) -> Column:
    """The rate of a document after these steps, from its posterior."""
    r = F.lit(1.0)
    for step in steps:
        move = sum((F.lit(s) * F.col(f"p_{d}") for d, s in zip(DOMAINS, step, strict=True)), F.lit(0.0))
        r = F.greatest(r - move, F.lit(0.0))
    return r


def fit(narrow: DataFrame, targets: dict[str, float] = TARGETS, whole: str = "good") -> tuple[list[list[float]], dict[str, float]]:
    """Steps of the projected gradient over (n_tokens, posteriors), and the target tokens by domain."""
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tokens = F.col("n_tokens").cast("double")

    def totals(rates: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column of rates: expected tokens by domain, and the Gram matrix over the documents that still have one."""
        named = narrow.select("n_tokens", *p, *[r.alias(f"r{i}") for i, r in enumerate(rates)])
        sums = []
        for k in range(len(rates)):
            r = F.col(f"r{k}")
            sums += [F.sum(r * tokens * x) for x in p] + [F.sum(F.when(r > 0, tokens * p[i] * p[j])) for i, j in pairs]
        got = [x or 0.0 for x in named.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        out = []
        for k in range(0, len(got), len(p) + len(pairs)):
            gram = np.zeros((len(p), len(p)))
            for (i, j), x in zip(pairs, got[k + len(p) : k + len(p) + len(pairs)], strict=True):
                gram[i, j] = gram[j, i] = x
            out.append((np.array(got[k : k + len(p)]), gram))
        return out

    now, gram = totals([F.lit(1.0)])[0]
    share = sum(targets.values())
    budget = SLACK * now[DOMAINS.index(whole)] / (targets[whole] / share)
    aims = np.array([budget * targets[d] / share for d in DOMAINS])
    there = now > 0
    miss = lambda x: np.where(there, x - aims, 0.0)
    loss = lambda x: float((miss(x) ** 2 / np.maximum(aims, 1e-12) ** 2).sum())
    largest = max(float(np.linalg.norm(gram, 2)), 1e-12)
    steps: list[list[float]] = []
    while len(steps) < STEPS and (np.abs(miss(now)) > CLOSE * np.maximum(aims, 1e-12)).any():
        # The whole step and parts of it, and the plain gradient, are weighed in one pass over the documents.
        full = np.linalg.lstsq(gram + 1e-6 * largest * np.eye(len(p)), miss(now), rcond=1e-9)[0]
        tries = [full * x for x in (1.0, 0.5, 0.25, 0.1)] + [miss(now) / largest]
        seen = totals([rate([*steps, [float(x) for x in t]]) for t in tries])
        best = min(range(len(tries)), key=lambda k: loss(seen[k][0]))
        if loss(seen[best][0]) > (1 - 1e-6) * loss(now):
            break
        steps.append([float(x) for x in tries[best]])
        now, gram = seen[best]
    if missed := {d: f"{x / a:.4f}" for d, x, a in zip(DOMAINS, now, aims, strict=True) if x > 0 and abs(x - a) > CLOSE * max(a, 1e-12)}:
        warnings.warn(f"mixing: after {len(steps)} passes the domains hold this share of their target tokens: {missed}", stacklevel=2)
    return steps, dict(zip(DOMAINS, aims.tolist(), strict=True))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, whole: str = "good") -> DataFrame:
    """(doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies, drawn): every document's fitted rate, how often one draw takes it, and whether at all."""
    keyed = docs.select("doc_id", "text", draw().alias("u"))
    narrow = Shelf(docs.sparkSession).put(posteriors(keyed, train(docs, labels)).select("doc_id", "u", *ADDED))
    steps, _ = fit(narrow, targets, whole)
    return narrow.withColumn("rate", rate(steps)).withColumn("copies", copies(F.col("rate"), F.col("u"))).withColumn("drawn", F.col("copies") > 0).drop("u")


def draw() -> Column:
    """A number in [0, 1) from the row's id and text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) / float(1 << 24)


def copies(r: Column, u: Column) -> Column:
    """How often a document at rate ``r`` is taken with draw ``u``; ``r`` times in the mean."""
    return F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)


def thinned(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, whole: str = "good") -> DataFrame:
    """The documents that one draw at the fitted rates takes, each as often as it is taken, with their own columns only.

    Posteriors are computed once and stand beside the documents in the shared folder until the rates are known.
    """
    columns = docs.columns
    wide = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"), draw().alias("u"))
    held = Shelf(docs.sparkSession).put(posteriors(wide, train(docs, labels)).drop("text"))
    steps, _ = fit(held.select(*ADDED), targets, whole)
    taken = held.withColumn("n", copies(rate(steps), F.col("u"))).where("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")
