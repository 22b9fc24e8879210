"""Snapshots of a corpus: eligibility, selection, differences, drift."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as a Java regular expression; only ** crosses segments, and a trailing ** may match none."""
    out = []
    parts = glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append("(?:/.*)?" if last and i else ".*" if last else "(?:[^/]+/)*")
            continue
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
        out.append(("/" if i and parts[i - 1] != "**" else "") + body)
    return "^" + "".join(out) + "$"


def eligibility(paths: DataFrame, rules: list[tuple[str, bool, bool]], path: str = "path") -> DataFrame:
    """Adds glob, eligible and needs_review: the most specific matching rule decides; none leaves 'unclassified'."""
    hits = [F.when(F.col(path).rlike(glob_regex(g)), F.struct(F.lit(g.count("/")).alias("s"), F.lit(len(g)).alias("n"), F.lit(-i).alias("o"), F.lit(g).alias("g"), F.lit(e).alias("e"))) for i, (g, e, _) in enumerate(rules)]
    review = F.lit(False)
    for g, e, flag in rules:
        if e and flag:
            review = review | F.col(path).rlike(glob_regex(g))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return paths.withColumn("__b", best).withColumn("glob", F.coalesce("__b.g", F.lit("unclassified"))).withColumn("eligible", F.coalesce("__b.e", F.lit(False))).withColumn("needs_review", review).drop("__b")


def diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, change, from_sha256, to_sha256, lastmod_changed): added, altered, removed or unchanged; the digest alone decides."""
    a = old.select(key, F.col(digest).alias("from_sha256"), F.col("lastmod").alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(digest).alias("to_sha256"), F.col("lastmod").alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("from_sha256").eqNullSafe(F.col("to_sha256")), "altered").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), "from_sha256", "to_sha256", (~F.col("was").eqNullSafe(F.col("now"))).alias("lastmod_changed"))


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: counts with zeros, and the kind of the change set."""
    n = {k: F.count_if(F.col("change") == k) for k in ("added", "altered", "removed", "unchanged")}
    got = changes.agg(*[v.alias(k) for k, v in n.items()])
    old = F.col("altered") + F.col("removed") + F.col("unchanged")
    kind = F.when(old == 0, "initial").when((F.col("altered") * 10 > old * 8) & (F.col("added") == 0) & (F.col("removed") == 0), "extractor_upgrade").otherwise("editorial")
    return got.withColumn("kind", kind)


def drift(prior: DataFrame, current: DataFrame, frozen: DataFrame, key: str = "path") -> DataFrame:
    """The cumulative drift report: checked paths speak for themselves, others keep what was known.

    prior: (key, state); current: (key, live_sha256, ok) of the paths checked now; frozen: (key, sha256).
    """
    seen = current.where("ok").join(frozen, key, "left")
    fresh = seen.select(key, F.when(F.col("sha256").isNull(), "added").when(F.col("sha256") != F.col("live_sha256"), "altered").otherwise("same").alias("now"))
    both = prior.join(fresh, key, "full_outer")
    return both.select(key, F.coalesce("now", "state").alias("state")).where("state <> 'same'")


def carried(previous: DataFrame, fetched: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """Every known path with its newest value; pages that were not fetched, or failed, keep theirs."""
    new = fetched.select(key, F.col(value).alias("__new"))
    return previous.select(key, F.col(value).alias("__old")).join(new, key, "full_outer").select(key, F.coalesce("__new", "__old").alias(value))


def select_for_fetch(entries: DataFrame, lock: DataFrame, slice_of: Column, todays: int | None, full: bool = False, key: str = "path") -> DataFrame:
    """Entries to fetch, with the first reason that holds: full, new, lastmod, sweep."""
    have = lock.select(key, F.col("lastmod").alias("known"), F.lit(True).alias("held"))
    sweep = F.lit(False) if todays is None else slice_of == todays
    why = F.when(F.lit(full), "full").when(F.col("held").isNull(), "new").when(~F.col("lastmod").eqNullSafe(F.col("known")), "lastmod").when(sweep, "sweep")
    return entries.join(have, key, "left").withColumn("reason", why).drop("known", "held").where("reason IS NOT NULL")


def chain(states: DataFrame, key: str = "path", order: str = "snapshot_id", digest: str = "sha256") -> DataFrame:
    """Changes between consecutive snapshots of each path."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("before", before).withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("before") != F.col(digest), "altered").otherwise("unchanged"))


def lock_digest(states: DataFrame, key: str = "path", digest: str = "sha256", width: int = 3) -> DataFrame:
    """One row: the digest of a whole lock, in two levels.

    Paths fall into 16 ** width cells by the first hex digits of their own sha256. A cell's digest is sha256 over its
    sorted paths and digests, NUL after each; the lock's is sha256 over the sorted cells and their digests, likewise. So
    cells are digested in parallel, and the last step sees one row a cell. Larger locks take a larger width.
    """
    framed = lambda rows, *names: F.array_join(F.transform(rows, lambda x: F.concat(*[p for n in names for p in (x[n].cast("string"), F.lit("\0"))])), "")
    cell = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, width).alias("cell")
    cells = states.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct(key, digest))).alias("r")).select("cell", F.sha2(framed(F.col("r"), key, digest), 256).alias("d"))
    return cells.agg(F.array_sort(F.collect_list(F.struct("cell", "d"))).alias("r")).select(F.sha2(framed(F.col("r"), "cell", "d"), 256).alias("lock_digest"))
