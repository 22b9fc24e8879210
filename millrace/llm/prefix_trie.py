"""The trie of conversation prefixes, from the sorted conversations and the lengths of their common prefixes.

A conversation becomes a binary key, 16 bytes a turn (of the SHA-256 of its role and text), so that bytes sort as turns do.
Equal conversations collapse to one sequence; sequences are sorted into blocks by range. Position i has the sequence i and
lcp[i], the turns that it shares with the one before (-1 at either end of all). Every trie node at which sequences part is a
node of the Cartesian tree over lcp: a maximal run of sequences between the nearest smaller values left and right.

One pass over each block finds the nearest smaller values inside it with a stack and merges equal ones. What stays open at a
block's edge asks the nearest block whose minimum is smaller: the block minima are a short list, the block's own falling and
rising minima are a table, and question and answer meet in a window by block. Nodes met in several blocks have the same two
neighbours and are merged by them. Counts, words and childless nodes of a run are differences of running sums. A node stands
for all depths down from its parent's; these are written out at the end, as are the depths below the last parting.

Unit of work: the keys and word counts of one conversation, about 24 bytes a turn, are one row; texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm._spark import Shelf

TURN = 16  #: bytes of key a turn
FAR = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"

_SEEN = "at: bigint, rep: bigint, v: int, block: int, n: bigint, weight: bigint, fresh: bigint, leaves: bigint, low: bigint, len: int, total: bigint, ends: string"
SCANNED = f"kind string, block int, rep bigint, v int, lower int, eq bigint, l struct<{_SEEN}>, r struct<{_SEEN}>, low bigint, before array<bigint>, n bigint, weight bigint, fresh bigint, leaves bigint, total bigint, ends string, parent bigint, lat bigint, rat bigint, len int"
DONE = ["rep", "lat", "rat", "v", "lower", "parent", "eq", "n", "leaves", "weight", "fresh", "low", "total", "len", "ends", "before"]


def lcp(a: bytes, b: bytes) -> int:
    """How many turns two keys share."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    if a[: hi * TURN] == b[: hi * TURN]:
        return hi
    while hi - lo > 1:  # lo turns are equal, hi are not
        mid = (lo + hi) // 2
        if a[lo * TURN : mid * TURN] == b[lo * TURN : mid * TURN]:
            lo = mid
        else:
            hi = mid
    return lo


def _between(l: dict, r: dict, rep: int, v: int, eq: int, low: int, before: list, lower: int, sums: dict | None = None) -> dict:  # noqa: E741
    """A node from its neighbours; ``sums`` has what stands before each block, where they lie in different ones."""
    top = max(l["v"], r["v"])
    diff = {k: r[k] - l[k] + (sums[k][r["block"]] - sums[k][l["block"]] if sums else 0) for k in ("n", "weight", "fresh", "leaves")}
    parent = l["rep"] if l["v"] >= r["v"] else r["rep"]
    return {
        "rep": rep, "lat": l["at"], "rat": r["at"], "v": v, "lower": top, "parent": parent if top >= 0 else None, "eq": eq, "low": low,
        "total": l["total"], "len": l["len"], "ends": l["ends"], "before": before[top - lower :], **diff,
    }


class _Block:
    """One pass over the sorted sequences of a block; gives rows of SCANNED."""

    def __init__(self, block: int, start: int, first: int, last: int):
        self.block, self.at, self.x, self.after = block, start - 1, first, last  # after: lcp with the next block's first; None at the end
        self.sums = dict.fromkeys(("n", "weight", "fresh", "leaves"), 0)
        self.stack: list[dict] = []
        self.low, self.least, self.own = FAR, FAR, None
        self.out: list[dict] = []

    def _place(self, v: int, rep: int | None) -> dict:
        return {"at": self.at, "rep": rep, "v": v, "block": self.block, "low": self.low, **self.sums}

    def _leave(self, x: int, following: int) -> None:
        """The sequence at hand ends; the next one shares x turns with it."""
        s = self.own
        if s is None:
            return
        self.sums["leaves"] += s["len"] > x
        self.sums["n"] += s["n"]
        self.sums["weight"] += s["n"] * s["total"]
        self.sums["fresh"] += s["fresh"]
        self.low = min(self.low, s["low"])
        u = max(s["x"], x)
        if s["len"] > u:
            parent = None if u < 0 else self.stack[-1]["rep"] if s["x"] >= x else following
            self.out.append({"kind": "leaf", "block": self.block, "v": s["len"], "lower": u, "n": s["n"], "total": s["total"], "ends": s["ends"], "low": s["low"], "parent": parent, "before": _slice(s["words"], u, s["len"])})

    def _pop(self, r: dict | None) -> None:
        e = self.stack.pop()
        below = self.stack[-1] if self.stack else None
        if below is not None:
            below["low"], below["tail"] = min(below["low"], e["low"]), min(below["tail"], e["low"])
        lower = below["v"] if below else -1
        if below is not None and r is not None:
            self.out.append({"kind": "done", "block": self.block, **_between(below["l"], r, e["rep"], e["v"], e["eq"], e["low"], e["before"], lower)})
        else:
            known = max(lower, r["v"] if r else -1)
            self.out.append({"kind": "open", "block": self.block, "rep": e["rep"], "v": e["v"], "eq": e["eq"], "lower": known, "l": below and below["l"] | {"low": e["low"]}, "r": r, "before": e["before"][known - lower :]})

    def add(self, key: bytes, words: list[int], n: int, low: int, ends: str) -> None:
        if self.own is not None:
            self.x = lcp(self.own["key"], key)
        x = self.x
        self._leave(x, self.at + 1)
        self.at += 1
        self.least = min(self.least, x)
        r = None
        while self.stack and self.stack[-1]["v"] > x:
            r = r or self._place(x, self.at)
            self._pop(r)
        total, size = sum(words), len(words)
        self.own = {"key": key, "words": words, "n": n, "low": low, "ends": ends, "x": x, "len": size, "total": total, "fresh": total - sum(words[: max(x, 0)])}
        here = {"at": self.at, "v": x, "block": self.block, **self.sums, "fresh": self.sums["fresh"] + self.own["fresh"], "len": size, "total": total, "ends": ends}
        if self.stack and self.stack[-1]["v"] == x:
            top = self.stack[-1]
            top["eq"] += 1
            top["l"] = here | {"rep": top["rep"]}
            top["tail"], top["low"] = low, min(top["low"], low)
        else:
            if not self.stack:
                self.out.append({"kind": "falling", "block": self.block, "v": x, "r": self._place(x, self.at)})
            below = self.stack[-1] if self.stack else None
            self.stack.append({"v": x, "rep": self.at, "eq": 1, "l": here | {"rep": self.at}, "tail": low, "low": min(below["tail"], low) if below else low, "before": _slice(words, below["v"] if below else -1, x)})

    def end(self) -> list[dict]:
        x = -1 if self.after is None else self.after
        self._leave(x, self.at + 1)
        self.at += 1
        suffix = FAR
        for e in reversed(self.stack):
            self.out.append({"kind": "rising", "block": self.block, "v": e["v"], "l": e["l"] | {"low": min(e["tail"], suffix)}})
            suffix = min(suffix, e["low"])
        r = self._place(-1, None) if self.after is None else None
        while self.stack and self.stack[-1]["v"] > -1:
            self._pop(r)
        self.out.append({"kind": "block", "block": self.block, "v": self.least, "low": self.low, **self.sums})
        return self.out


def _slice(words: list[int], lo: int, hi: int) -> list[int]:
    """The words before the turns of depth lo + 1 to hi; before the root, of depth 0, there are none."""
    if hi <= lo:
        return []
    sums = list(accumulate(words[: max(hi - 1, 0)], initial=0))
    return ([0] if lo < 0 else []) + sums[max(lo, 0) : hi]


def _scan(blocks: dict[int, tuple[int, int, int | None]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None
        for batch in batches:
            for block, key, words, n, low, ends in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "words", "n", "low", "ends")), strict=True):
                if now is None or now.block != block:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist(now.end(), schema)
                    now = _Block(block, *blocks[block])
                now.add(key, words, n, low, ends)
            if now is not None and now.out:
                yield pa.RecordBatch.from_pylist(now.out, schema)
                now.out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist(now.end(), schema)

    return run


def _aimed(mins: list[int], names: list[int], schema: pa.Schema):
    """Adds the blocks to ask: the nearest one on the open side whose minimum is smaller; -1 right of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {b: i for i, b in enumerate(names)}
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                i, v = place[row["block"]], row["v"]
                if row["l"] is None:
                    row["left"] = next(names[j] for j in range(i - 1, -1, -1) if mins[j] < v)
                if row["r"] is None:
                    row["right"] = next((names[j] for j in range(i + 1, len(names)) if mins[j] < v), -1)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _asked(rows: DataFrame, spine: DataFrame, target: str, into: str) -> DataFrame:
    """Fills ``into`` from the target block's spine: there the largest value below v is the nearest place with a smaller one."""
    others = [c for c in rows.columns if c != into]
    asks = F.struct(*others).alias("asks")
    told = spine.select("block", "v", F.lit(1).alias("given"), into, F.lit(None).cast(rows.select(asks).schema[0].dataType).alias("asks"))
    asked = rows.where(F.col(target).isNotNull()).select(F.col(target).alias("block"), "v", F.lit(0).alias("given"), F.lit(None).cast(spine.schema[into].dataType).alias(into), asks)
    upto = Window.partitionBy("block").orderBy("v", "given").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(told).withColumn(into, F.last(into, ignorenulls=True).over(upto)).where(F.col("asks").isNotNull())
    return rows.where(F.col(target).isNull()).unionByName(found.select("asks.*", into))


def _closed(names: list[int], lows: list[int], sums: dict[str, list[int]], end: int, schema: pa.Schema):
    """Open nodes whose neighbours are known by now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {b: i for i, b in enumerate(names)}
        before = {k: {b: s for b, s in zip([*names, -1], accumulate(v, initial=0), strict=True)} for k, v in sums.items()}
        nothing = {"at": end, "rep": None, "v": -1, "block": -1, "n": 0, "weight": 0, "fresh": 0, "leaves": 0, "low": FAR}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                l, r = row["l"], row["r"] or nothing  # noqa: E741
                inner = lows[place[l["block"]] + 1 : place.get(r["block"], len(names))]
                out.append(_between(l, r, row["rep"], row["v"], row["eq"], min([l["low"], r["low"], *inner]), row["before"], row["lower"], before))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, ends): SHA-256 of the ids of each sequence's conversations; ids come in order and are never held together."""
    now, digest = None, None
    for batch in batches:
        keys, ids = batch.column("h").to_pylist(), list(map(str, batch.column("conv_id").to_pylist()))
        out, lo = [], 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            said = ",".join(ids[lo:hi]).encode()
            if keys[lo] == now:
                digest.update(b"," + said)
            else:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = keys[lo], hashlib.sha256(said)
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["h", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["h", "ends"])


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, digests, words) of (conv_id, turn, role, text), by turn, null first; equal turns by digest.

    Null role or text counts as empty; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.substring(F.sha2(framed, 256), 1, 2 * TURN).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    got = rows.where(F.col("conv_id").isNotNull()).select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: t["digest"]).alias("digests"), F.transform("t", lambda t: t["words"].cast("long")).alias("words"))


def rebuilt(convs: DataFrame, period: int = 20) -> DataFrame:
    """Each conversation c with its first h = crc32(c) mod 4 turns replaced by those of conversation c - c % period, where that has any."""
    heads = convs.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, 3).alias(f"{c}_0") for c in ("digests", "words")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % period).join(heads, "base", "left")
    whole: Column = lambda c: F.concat(F.coalesce(F.slice(f"{c}_0", F.lit(1), h), F.slice(c, 1, 0)), F.slice(c, h + 1, F.size(c)))
    return both.select("conv_id", whole("digests").alias("digests"), whole("words").alias("words"))


def trie(convs: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, digests, words), one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member; repeated ids are members as often as they stand there. No conversations, no root.
    blocks: into how many ranges the sequences are sorted; the session's shuffle partitions where not given.
    """
    shelf = Shelf(convs.sparkSession)
    key = F.unhex(F.array_join("digests", "")).alias("key")
    keyed = shelf.put(convs.select("conv_id", key, "words").withColumn("h", F.unhex(F.sha2("key", 256))))
    in_order = keyed.select("h", "conv_id").repartition("h").sortWithinPartitions("h", "conv_id")
    sequences = keyed.groupBy("h").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    sequences = sequences.join(in_order.mapInArrow(_ends, "h binary, ends string"), "h").drop("h")
    ranged = sequences.repartitionByRange(blocks, "key") if blocks else sequences.repartitionByRange("key")
    ranged = shelf.put(ranged.sortWithinPartitions("key").withColumn("block", F.spark_partition_id()))
    shelf.drop(keyed)

    # one row a block, a partition of the sort: where it starts, what it shares with the blocks beside it
    shared = F.udf(lambda a, b: None if a is None or b is None else lcp(bytes(a), bytes(b)), "int")
    edges = ranged.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    beside = Window.orderBy("block")
    edges = edges.select("block", "n", "first", F.lag("last").over(beside).alias("before")).select("block", "n", shared("before", "first").alias("x")).collect()
    edges.sort(key=lambda e: e.block)
    starts = list(accumulate((e.n for e in edges), initial=0))
    xs = [-1 if e.x is None else e.x for e in edges]
    known = {e.block: (starts[i], xs[i], xs[i + 1] if i + 1 < len(edges) else None) for i, e in enumerate(edges)}

    schema = StructType.fromDDL(SCANNED)
    scanned = shelf.put(ranged.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_scan(known, to_arrow_schema(schema)), schema))
    shelf.drop(ranged)
    summary = sorted(scanned.where("kind = 'block'").select("block", "v", "low", "n", "weight", "fresh", "leaves").collect(), key=lambda b: b.block)
    names, mins, lows = [b.block for b in summary], [b.v for b in summary], [b.low for b in summary]
    sums = {k: [b[k] for b in summary] for k in ("n", "weight", "fresh", "leaves")}

    opened = scanned.where("kind = 'open'").select("block", "rep", "v", "lower", "eq", "l", "r", "before")
    aimed_schema = StructType([*opened.schema.fields, *StructType.fromDDL("left int, right int").fields])
    aimed = opened.mapInArrow(_aimed(mins, names, to_arrow_schema(aimed_schema)), aimed_schema)
    aimed = _asked(aimed, scanned.where("kind = 'rising'"), "left", "l")
    aimed = _asked(aimed, scanned.where("kind = 'falling'"), "right", "r")
    done = scanned.where("kind = 'done'").select(*DONE)
    late = shelf.put(aimed.mapInArrow(_closed(names, lows, sums, starts[-1], to_arrow_schema(done.schema)), done.schema))
    merged = late.groupBy("lat", "rat").agg(F.sum("eq").alias("eq"), *[F.first(c).alias(c) for c in DONE if c not in ("lat", "rat", "eq")]).select(*DONE)

    named = done.unionByName(late).select(F.col("rep").alias("parent"), F.col("low").alias("above"))
    nodes = done.unionByName(merged).select(*[c for c in DONE if c not in ("lat", "rat", "rep")], F.lit(False).alias("alone"))
    ending = scanned.where("kind = 'leaf'").withColumn("alone", F.lit(True)).withColumn("len", F.col("v")).withColumn("leaves", F.lit(1).cast("long"))
    nodes = nodes.unionByName(ending.select(*nodes.columns)).join(named, "parent", "left")
    nodes = nodes.select("*", F.posexplode("before").alias("step", "words"))
    depth = F.col("lower") + 1 + F.col("step")
    at_end = depth == F.col("v")
    kids = F.when(~at_end, F.lit(1)).when(F.col("alone"), F.lit(0)).otherwise(F.col("eq") + 1 - (F.col("len") == F.col("v")).cast("int"))
    saved = F.when(F.col("alone"), (F.col("n") - 1) * (F.col("total") - F.col("words"))).otherwise(F.col("weight") - F.col("n") * F.col("words") - (F.col("fresh") + F.col("total") - F.col("words")))
    return nodes.select(
        F.col("low").alias("conv_id"), depth.cast("long").alias("depth"), F.when(depth > 0, F.when(F.col("step") == 0, F.col("above")).otherwise(F.col("low"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), kids.cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(at_end & (F.col("len") == F.col("v")), F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


SQL = r"""
WITH t AS (
    SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS g,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL
), n AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS k, g, words FROM t
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295::BIGINT), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, k, g, words FROM c JOIN n ON n.conv_id = c.base AND k <= h
    UNION ALL SELECT c.conv_id, k, g, words FROM c JOIN n ON n.conv_id = c.conv_id AND k > h
), p AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, words, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM r
), m AS (
    SELECT conv_id, d, words, prefix FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c
), nodes AS (
    SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM m GROUP BY prefix, d
), ends AS (
    SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM m JOIN (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) USING (conv_id, d) GROUP BY prefix
), kids AS (
    SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
    SELECT left(prefix, 32 * a) AS prefix, sum((n - 1) * words) AS saved, count(*) FILTER (kids IS NULL) AS leaves
    FROM (SELECT nodes.*, kids, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN kids USING (prefix)) GROUP BY 1
)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
    saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN below USING (prefix) LEFT JOIN kids USING (prefix) LEFT JOIN ends USING (prefix)
LEFT JOIN nodes up ON nodes.d > 0 AND up.d = nodes.d - 1 AND up.prefix = left(nodes.prefix, 32 * (nodes.d - 1))
"""
