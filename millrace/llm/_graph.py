"""Connected components by alternating large-star and small-star, two aggregates a round; hubs are pre-aggregated map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import Shelf


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v: hang all of u's smaller neighbours, and u, on the smallest."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _spread(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node in its neighbourhood."""
    both = pairs.select("u", "v").union(pairs.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in _star


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str, shelf: Shelf) -> DataFrame:
    """(node, root): the smallest node each linked node reaches; nodes are of any type with an order. Nodes without a link are absent."""
    pairs = shelf.put(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = _mark(pairs)
    while before[0]:
        after = shelf.put(_star(_spread(pairs)))
        shelf.drop(pairs)
        pairs = after
        now = _mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
