"""Removal of passages that an earlier document holds, by difference-cover suffix sorting over shared stretches.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Exact copies of a text go whole to the text with the smallest id, so each distinct text is sorted once.
2. Every window of LENGTH bytes belongs to its anchor, the K-byte string in it with the smallest hash; equal windows
   have equal anchors. Anchors found in one text only are left out, since none of their windows can be shared; they are
   counted packed (see _packed), without a row an anchor.
3. What remains are short contexts: the stretch of windows that share an anchor. Equal contexts collapse, with their
   smallest id, before they are dealt to buckets by anchor, so a passage in a third of all documents is one row a task.
4. Each bucket sorts the suffixes of its contexts by the difference cover modulo 3: sampled triples are sorted and
   named, names are sorted recursively until they span LENGTH bytes, the remaining suffixes are sorted by their first
   byte and the next rank, and both orders are merged. Neighbours in the order are compared over LENGTH bytes; runs of
   equal ones are one string, which starts in the smallest id of its contexts. An anchor with more than HOT contexts
   is not given to one task: its windows are dealt one by one and equal ones meet in a map-side aggregate.
5. Each document merges the windows whose string starts in a smaller id, and hashes what is left.

Only step 4 orders bytes; steps 1 to 3 decide what has to be ordered and where, and drop no window that could count.

Defined results: null text is empty; texts under LENGTH bytes stay; rows with the same id never trim each other, nor
does a row with a null id trim or lose anything; repeated rows stay; an empty table gives no rows; only the id and the
text are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _batch
from millrace.llm._packed import shared_lists
from millrace.llm._spark import Shelf, among, small_batches

LENGTH, K = 50, 32
SPAN = LENGTH - K + 1  #: places of the anchor in a window
CHUNK = 1 << 19  #: bytes handled at once; must stay below 1 << 21
CONTEXTS = 6_000  #: contexts in a bucket, about
HOT = 3_000  #: contexts of one anchor beyond which its windows are dealt one by one
_TABLE = np.random.RandomState(50).randint(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 21) - 1)


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, begins in the piece) so that every window starts in exactly one piece; long rows are cut with an overlap."""
    n, row = len(at) - 1, 0
    while row < n:
        size = at[row + 1] - at[row]
        if size > CHUNK:
            for s in range(0, int(size) - LENGTH + 1, CHUNK):
                yield int(at[row]) + s, int(min(at[row + 1], at[row] + s + CHUNK + LENGTH - 1)), np.array([row]), np.array([0])
            row += 1
            continue
        last = row
        while last < n and at[last + 1] - at[row] <= CHUNK:
            last += 1
        yield int(at[row]), int(at[last]), np.arange(row, last), at[row:last] - at[row]
        row = last


def runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor hash, first window, last window) of each stretch of windows with one anchor; places count from data's start."""
    for begin, end, rows, begins in _pieces(at):
        buf = data[begin:end]
        n = len(buf)
        if n < LENGTH:
            continue
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[buf] * _batch._power(n, "mul", _batch._MUL), out=sums[1:])
            h = _batch.mix((sums[K:] - sums[:-K]) * _batch._power(n, "inv", _batch._INV)[: n - K + 1])
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])  # after these, minima over 16 places
        low = np.minimum(low[: -(SPAN - 16)], low[SPAN - 16 :])  # SPAN lies between 17 and 32
        ends = np.append(begins[1:], n)
        left = np.repeat(ends, np.diff(np.append(begins, n)))[: len(low)] - np.arange(len(low))
        ok = left >= LENGTH
        place = np.flatnonzero(ok)
        if not len(place):
            continue
        anchor = (low[place] & _LOW).astype(np.int64)
        fresh = np.ones(len(place), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(place)) - 1
        owner = rows[np.searchsorted(begins, place[first], "right") - 1]
        yield owner, h[anchor[first]], place[first] + begin, place[last] + begin


def ranks(s: np.ndarray, span: int = 1) -> np.ndarray:
    """Ranks of all suffixes of s by at least their first LENGTH bytes, by the difference cover {1, 2} modulo 3.

    s: non-negative integers, each of which stands for ``span`` bytes. Equal ranks mean equal prefixes.
    """
    n = len(s)
    wide = np.append(s, np.zeros(3, s.dtype)) if n else s
    if n < 3:
        return np.unique(wide[:n] * (int(s.max(initial=0)) + 1) + wide[1 : n + 1], return_inverse=True)[1] if n else s
    top = int(s.max()) + 1
    sample = np.flatnonzero(np.arange(n) % 3)
    sample = np.concatenate([sample[sample % 3 == 1], sample[sample % 3 == 2]])
    if top > 1_500_000:  # three symbols don't fit into 64 bits: pairs are named first
        pair = np.unique(wide[:-1] * top + wide[1:], return_inverse=True)[1].astype(np.int64)
    else:
        pair = wide[:-1] * top + wide[1:]
    # sort the sampled triples and name them
    triple = pair[sample] * top + wide[sample + 2]
    names = np.unique(triple, return_inverse=True)[1].astype(np.int64)
    if int(names.max()) + 1 < len(sample) and 3 * span < LENGTH:
        ones = int((np.arange(n) % 3 == 1).sum())
        apart = np.concatenate([names[:ones] + 1, [0], names[ones:] + 1])  # the two residues don't run into each other
        deep = ranks(apart, 3 * span)
        names = np.concatenate([deep[:ones], deep[ones + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names + 1
    # the remaining suffixes: first symbol, then the rank of the next one
    rest = np.arange(0, n, 3)
    many = int(rank.max()) + 1
    key0 = wide[rest] * many + rank[rest + 1]
    # merge: a remaining suffix meets residue 1 by one symbol and a rank, residue 2 by two symbols and a rank
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    key1 = wide[one] * many + rank[one + 1]
    key2 = pair[two] * many + rank[two + 2]
    key02 = pair[rest] * many + rank[rest + 2]
    # (queries are asked in sorted order, which keeps the searches near each other)
    by0, by1, by2 = (np.argsort(k, kind="stable") for k in (key0, key1, key2))
    sorted0, sorted1, sorted2 = key0[by0], key1[by1], key2[by2]
    sorted02 = np.sort(key02)
    # place each suffix: how many suffixes of each residue come before it
    out = np.empty(n, np.int64)
    out[rest[by0]] = np.searchsorted(sorted0, sorted0, "left") + np.searchsorted(sorted1, sorted0, "left")
    out[rest[by0]] += np.searchsorted(sorted2, key02[by0], "left")
    counts = np.bincount(rank[sample], minlength=many)
    before = np.cumsum(counts) - counts
    out[one[by1]] = np.searchsorted(sorted0, sorted1, "left")
    out[two[by2]] = np.searchsorted(sorted02, sorted2, "left")
    out[sample] += before[rank[sample]]
    return out


def shared_starts(text: np.ndarray, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window that starts at ``start`` in text: the smallest owner among equal windows."""
    order = start[np.argsort(ranks(text.astype(np.int64) + 1)[start], kind="stable")]
    who = np.full(len(text) + 1, np.iinfo(np.int64).max)
    who[start] = owner
    views = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    fresh = np.ones(len(order), bool)
    for lo in range(1, len(order), 100_000):
        hi = min(len(order), lo + 100_000)
        fresh[lo:hi] = (views[order[lo - 1 : hi - 1]] != views[order[lo:hi]]).any(1)
    first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(who[order], first) if len(order) else who[:0]
    who[order] = least[np.cumsum(fresh) - 1]
    return who[start]


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, at = _batch.buffers(batch.column("text"))
            got = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
            both = np.frombuffer(b"".join(got), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "lo", "hi"])

    return docs.mapInArrow(run, "doc_id long, lo long, hi long")


def _anchors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct anchors of each text, for shared_lists."""
    data, at = _batch.buffers(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for row, h, _, _ in runs(data, at):
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        fresh = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
        row, h = row[fresh], h[fresh]
        rows, sizes = np.unique(row, return_counts=True)
        yield ids[rows].astype(np.int64), sizes, h


def _contexts(docs: DataFrame) -> DataFrame:
    """(anchor, context, doc_id, lo, start) of the stretches whose anchor is in the row's list ``shared``."""

    def run(batches):
        for batch in batches:
            data, at = _batch.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("shared")
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            listed = [np.sort(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            own = {}
            for row, h, p, q in runs(data, at):
                h = h.view(np.int64)
                keep = np.zeros(len(row), bool)
                edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                for a, b in zip(edges, np.append(edges[1:], len(row)), strict=True):
                    have = listed[row[a]]
                    keep[a:b] = have[np.minimum(np.searchsorted(have, h[a:b]), len(have) - 1)] == h[a:b]
                row, h, p, q = row[keep], h[keep], p[keep], q[keep]
                if not len(row):
                    continue
                for r in np.unique(row):
                    if r not in own:
                        own[r] = int.from_bytes(hashlib.blake2b(data[at[r] : at[r + 1]], digest_size=16).digest()[:8], "little", signed=True)
                texts = [data[a : b + LENGTH].tobytes() for a, b in zip(p, q, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(texts, pa.binary()), pa.array(ids[row].astype(np.int64)), pa.array(np.array([own[r] for r in row], np.int64)), pa.array((p - at[row]).astype(np.int64))], names=["anchor", "context", "doc_id", "lo", "start"])

    return docs.mapInArrow(run, "anchor long, context binary, doc_id long, lo long, start long")


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """(c1, c2, begin, end, least): by context, stretches of windows and the smallest id in which their strings start."""
    table = table.combine_chunks()
    anchor = table.column("anchor").to_numpy()
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = size[group] == 1  # nothing to order
    single, table = table.filter(pa.array(alone)), table.filter(pa.array(~alone))
    lengths = pc.binary_length(single.column("context")).to_numpy().astype(np.int64)
    whole = pa.table({"c1": single.column("c1"), "c2": single.column("c2"), "begin": np.zeros(len(lengths), np.int64), "end": lengths, "least": single.column("doc_id")})
    if not table.num_rows:
        return whole
    texts = table.column("context").to_pylist()
    owner = table.column("doc_id").to_numpy()
    sizes = np.array([len(x) for x in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    least = shared_starts(text, start, owner[which])
    fresh = np.ones(len(which), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(which)) - 1
    row = which[first]
    ordered = pa.table({"c1": table.column("c1").to_numpy()[row], "c2": table.column("c2").to_numpy()[row], "begin": start[first] - begins[row], "end": start[last] - begins[row] + LENGTH, "least": least[first]})
    return pa.concat_tables([whole, ordered])


def _trimmed(docs: DataFrame) -> DataFrame:
    """The result rows, from texts with the list ``cuts`` of (lo, begin, end) found for their id, and the digests of its copies."""

    def run(batches):
        for batch in batches:
            data, at = _batch.buffers(batch.column("text"))
            copies = batch.column("copies").to_pylist()
            lists = batch.column("cuts")
            flat = lists.flatten()
            own_lo, begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            many = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(many)])
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                body = data[at[i] : at[i + 1]].tobytes()
                merged = []
                own = int.from_bytes(hashlib.blake2b(body, digest_size=16).digest()[:8], "little", signed=True) if copies[i] or many[i] else 0
                if copies[i] and own in copies[i]:
                    merged = [(0, len(body))] if len(body) >= LENGTH else []
                elif many[i]:
                    mine = np.flatnonzero(own_lo[upto[i] : upto[i + 1]] == own) + upto[i]
                    mine = mine[np.argsort(begin[mine], kind="stable")]
                    if len(mine):
                        reach = np.maximum.accumulate(end[mine])
                        first = np.flatnonzero(np.append(True, begin[mine][1:] > reach[:-1]))
                        merged = list(zip(begin[mine][first].tolist(), reach[np.append(first[1:], len(mine)) - 1].tolist(), strict=True))
                left, place = [], 0
                for a, b in merged:
                    left.append(body[place:a])
                    place = b
                left.append(body[place:])
                removed.append(sum(b - a for a, b in merged))
                spans.append([{"begin": a, "end": b} for a, b in merged])
                kept.append(b"".join(left))
            pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")


def trim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): one row per row; spans are the maximal removed stretches, kept the bytes left."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession)
    known = shelf.put(_digests(docs.where("doc_id IS NOT NULL")))
    owners = shelf.put(known.groupBy("lo", "hi").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"))
    own = known.join(owners, ["lo", "hi"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)))
    copies = own.groupBy("doc_id").agg(F.bool_and("copy").alias("whole"), F.collect_set(F.when(F.col("copy"), F.col("lo"))).alias("copies"))
    copies = shelf.put(copies.where(F.size("copies") > 0))  # an id with several texts may have some that are copies
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shelf.drop(known, owners)

    texts = among(docs.where("doc_id IS NOT NULL"), copies.where("whole").select("doc_id"), "doc_id", "left_anti")
    anchors = shared_lists(texts, _anchors, 2 * total // (SPAN + 1))
    lists = shelf.put(anchors.select(F.col("id").alias("doc_id"), F.col("values").alias("shared")))
    # The contexts are taken from the texts twice: once for where they stand, without their bytes, and once for the
    # distinct ones. That is cheaper than a table of all contexts, which overlap several times over.
    found = _contexts(texts.join(lists, "doc_id")).withColumn("c1", F.xxhash64("context")).withColumn("c2", F.xxhash64("context", F.lit(1)))
    distinct = shelf.put(found.groupBy("anchor", "c1", "c2").agg(F.first("context").alias("context"), F.min("doc_id").alias("doc_id")))
    hot = shelf.put(distinct.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"))
    buckets = max(1, -(-distinct.count() // CONTEXTS))
    dealt = distinct.join(hot, "anchor", "left_anti").select(F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(buckets)).alias("bucket"), "anchor", "c1", "c2", "context", "doc_id")
    strings = dealt.groupBy("bucket").applyInArrow(_sorted_bucket, "c1 long, c2 long, begin long, end long, least long")
    # The windows of a hot anchor are dealt one by one: equal ones are counted map-side, and no task holds an anchor.
    alone = distinct.join(hot, "anchor", "left_semi").select("c1", "c2", "doc_id", F.posexplode(F.expr(f"transform(sequence(1, length(context) - {LENGTH - 1}), i -> substring(context, i, {LENGTH}))")).alias("begin", "window"))
    least = shelf.put(alone.groupBy("window").agg(F.min("doc_id").alias("least")))
    single = alone.join(least, "window").select("c1", "c2", F.col("begin").cast("long").alias("begin"), (F.col("begin") + LENGTH).cast("long").alias("end"), "least")
    strings = shelf.put(strings.unionByName(single))
    shelf.drop(distinct, hot, least)
    places = shelf.put(found.select("c1", "c2", "doc_id", "lo", "start"))
    shelf.drop(lists)
    cuts = places.join(strings, ["c1", "c2"]).where("least < doc_id")
    cuts = shelf.put(cuts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))).alias("cuts")))
    shelf.drop(places, strings)
    marked = docs.join(cuts, "doc_id", "left").join(copies.select("doc_id", "copies"), "doc_id", "left")
    return _trimmed(marked.select("doc_id", "text", "cuts", "copies"))
