"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of code points is a closed syncmer when the smallest hash among its inner s-mers is that of the first or the
last one. The choice looks at the k-mer alone, so equal passages give equal anchors wherever they stand, and the
anchors of a text are those of its overlapping pieces, each moved to its place. A text is therefore cut into pieces
(each k - 1 code points into the next): the arrays of one piece are all that is computed at a time. The smallest of the
inner s-mers is taken by doubling: minima over 2, 4 and 8 places, two of which overlap to cover the inner ones.

Anchors: all closed syncmers of the whole text, with their places, about 2 / (K - S + 1) a code point; nothing is capped
or sampled. Fingerprint: the anchors in the order of their places, 8 hex digits each. Likeness: the Jaccard likeness of
the two sets of anchors, exact. matches() pairs the anchors that two texts hold once each, by place: where they stand,
so that moved passages show. A text without a closed syncmer, as one shorter than k, has one anchor, its own hash.

Defined results: null text is empty; an empty text has the empty fingerprint, is like another empty text (1.0) and
unlike all else (0.0); repeated rows stay and follow each other by (doc_id descending, text descending); null doc_ids
come last; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, PIECE = 20, 4, 2048
W = K - S + 1  #: inner s-mers of a k-mer; the doubling below fits 17


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _piece_anchors(piece: Column, start: Column) -> Column:
    """array<struct<at, anchor>> of one piece of at least K code points that starts at ``start``."""

    def chosen(h: Column) -> Column:
        over = lambda values, step: _let(values, lambda x: F.transform(x, lambda v, i: F.least(v, F.get(x, i + step))))
        eight = over(over(over(h, 1), 2), 4)  # at i: the least of h[i] .. h[i + 7]

        def marked(m: Column) -> Column:
            def closed(i: Column) -> Column:
                return F.least(F.get(h, i), F.get(h, i + (W - 1))) <= F.least(F.get(m, i + 1), F.get(m, i + (W - 9)))

            at = F.filter(F.sequence(F.lit(0), F.size(h) - W), closed)
            return F.transform(at, lambda i: F.struct((start + i).cast("int").alias("at"), F.hash(F.get(h, i), F.get(h, i + W // 2), F.get(h, i + (W - 1))).alias("anchor")))

        return _let(eight, marked)

    smers = lambda x: F.slice(F.transform(x, lambda c, i: F.xxhash64(c, *[F.get(x, i + j) for j in range(1, S)])), 1, F.size(x) - (S - 1))
    return _let(_let(F.split(piece, ""), smers), chosen)


def _syncmers(text: Column) -> Column:
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - K, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: _piece_anchors(F.substring(text, at + 1, F.lit(PIECE + K - 1)), at))
    return F.when(n < K, F.array().cast("array<struct<at:int,anchor:int>>")).otherwise(F.flatten(pieces))


def anchors(text: Column) -> Column:
    """array<struct<at, anchor>>: the closed syncmers of a whole text, in order; its own hash where it has none."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(text).alias("anchor")))
    return _let(_syncmers(text), lambda found: F.when((F.size(found) == 0) & (F.length(text) > 0), whole).otherwise(found))


def names(found: Column) -> Column:
    """array<int>: the anchors without their places."""
    return F.transform(found, lambda a: a["anchor"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two lists of anchors, as sets."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) & (y == 0), 1.0).otherwise(both / (x + y - both))


def matches(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, other, anchor, at, other_at): where anchors that two texts hold once each stand in either; an equi-join on the anchor.

    left, right: key and ``anchors``. An anchor found in many texts of ``right`` joins with each of them.
    """
    once = lambda df, name, place: df.select(F.col(key).alias(name), F.explode("anchors").alias("a")).groupBy(name, F.col("a.anchor").alias("anchor")).agg(F.min("a.at").alias(place), F.count("*").alias("n")).where("n = 1").drop("n")
    met = once(left, key, "at").join(once(right, "other", "other_at"), "anchor").where(F.col(key) != F.col("other"))
    return met.select(key, "other", "anchor", "at", "other_at")


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), "")


def _ranges(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``at``: the range of doc_id (0 first) a row falls in, about equal in rows. Two numbers per range reach the driver."""
    cells = 32
    qs = [i / cells for i in range(cells + 1)]
    got = df.agg(F.percentile_approx("doc_id", F.lit(qs), F.lit(1000)).alias("q")).first()["q"]
    bounds = sorted(set(got or [0]))
    each = max(1, parts // max(1, len(bounds) - 1))
    at = F.lit(0)
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        inside = F.floor((F.col("doc_id") - lo).cast("double") * each / float(hi - lo)).cast("int")
        at = F.when(F.col("doc_id") >= lo, i * each + F.least(inside, F.lit(each - 1)) + 1).otherwise(at)
    return df.withColumn("at", F.coalesce(F.when(F.col("doc_id").isNull(), -1).otherwise(at), F.lit(0)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, next_text, at, guard): each row and the text that follows it by descending doc_id, the last followed by the first.

    Rows are dealt by ranges of doc_id; the top row of each range is also sent, as a guard, to the range above it, so
    the order is followed across ranges in one shuffle of the texts. Guards stay in the result for a second look ahead.
    """
    rows = _ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    heads = rows.groupBy("at").agg(F.max("doc_id").alias("doc_id"))
    whole = Window.orderBy(F.col("at").desc())  # one row per range
    heads = heads.select("at", F.col("doc_id").alias("head"), F.lag("at").over(whole).alias("above"), F.last("at").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))
    heads = heads.select("at", "head", F.coalesce("above", "lowest").alias("to"))
    rows = rows.join(F.broadcast(heads), "at")  # at most `parts` + 2 rows
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    places = F.when(is_head, F.array(F.struct(F.col("at"), F.lit(0).alias("guard")), F.struct(F.col("to").alias("at"), F.lit(1).alias("guard")))).otherwise(F.array(F.struct(F.col("at"), F.lit(0).alias("guard"))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.at", "p.guard")
    return rows.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("at").orderBy("guard", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors): the operator proper, one row per row."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("anchors", anchors(F.col("text")))


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the likenesses asked for; see the module's contract."""
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, parts).withColumn("n", F.length("text")).withColumn("m", F.floor(F.col("n") / 3).cast("int"))
    rows = rows.withColumn("head", F.left("text", F.col("n") - F.col("m"))).withColumn("lent", F.left(F.coalesce("next_text", F.lit("")), F.col("m")))
    # Anchors wholly before the cut are those of the head; the rest stand in what follows it, K - 1 code points earlier on.
    back = F.right(F.col("head"), F.lit(K - 1))
    rows = rows.withColumn("edited", F.concat("head", "lent")).withColumn("s0", names(_syncmers(F.col("head"))))

    def joined(rest: Column, whole: str) -> Column:
        own = F.array(F.hash(F.col(whole)))
        return _let(F.concat("s0", names(_syncmers(rest))), lambda found: F.when((F.size(found) == 0) & (F.length(F.col(whole)) > 0), own).otherwise(found))

    of_text, of_edited = joined(F.concat(back, F.right("text", F.col("m"))), "text"), joined(F.concat(back, F.col("lent")), "edited")
    rows = rows.select("doc_id", "at", "guard", "text", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), of_text.alias("a"), of_edited.alias("e"))
    rows = rows.withColumn("b", F.lead("a").over(_order())).where("guard = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"))
