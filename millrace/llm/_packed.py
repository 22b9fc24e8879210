"""Which values of a set stand in several sets, without a row per value: values travel packed, dealt by their high bits.

A task packs the values of a few hundred sets at a time (a chunk) into one row a bucket. A value that stands in several
sets of one chunk is sent once, with a mark that says so; hence the most common value costs one entry a chunk, and no
bucket grows with the number of sets that hold it. A bucket is a range of hash values, about PER_BUCKET of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import _batch

PER_BUCKET = 1_500_000  #: values in a bucket, about
PER_PART = 1 << 25  #: values whose sets are summed up in one group, about
CHUNK = 500_000  #: values packed at once
SLICE = 100_000  #: values looked up at once
WIDTH = 5  #: bytes kept of a value; its bucket gives more bits

Sets = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]  #: ids of sets, sizes, values (distinct in a set, set by set)


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that equal high bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _low(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unlow(raw: list, width: int) -> np.ndarray:
    got = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    if width == 8:
        return got.ravel().view(np.uint64)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :width] = got
    return out.view(np.uint64).ravel()


def _chunk(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray, buckets: int, width: int) -> pa.RecordBatch:
    order = np.sort(values)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    owner = np.repeat(np.arange(len(ids)), sizes)
    if len(twice):
        here = twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values
    else:
        here = np.zeros(len(values), bool)
    known = np.bincount(owner[here], minlength=len(ids)).astype(np.uint32)
    sure = values[here]
    owner, values = owner[~here], values[~here]
    deal = lambda v: ((v >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    at, marks = deal(values), deal(twice)
    by = np.argsort(at, kind="stable")
    at, owner, values = at[by], owner[by], values[by]
    full = np.unique(np.concatenate([at, marks]))
    first = bool(len(full)) and int(full[0])
    rows = []
    for b in full.tolist():
        lo, hi = np.searchsorted(at, [b, b + 1])
        mine, many = np.unique(owner[lo:hi], return_counts=True)
        rows.append((b, _planes(ids[mine]), _planes(many.astype(np.uint32)), _low(values[lo:hi], width), _low(twice[slice(*np.searchsorted(marks, [b, b + 1]))], width), b"", b"", b""))
    told = np.flatnonzero(known)
    if len(told):
        rows.append((first, b"", b"", b"", b"", _planes(ids[told]), _planes(known[told]), _low(sure, 8) if width == 8 else b""))
    names = ["bucket", "ids", "many", "vals", "marks", "told", "known", "sure"]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 8)]], names=names)


def _counted(table: pa.Table, parts: int, width: int) -> pa.Table:
    """By part of the ids: ids, how many of their values are shared, and with all 8 bytes at hand the values themselves."""
    col = lambda name: [x.as_buffer() for x in table.column(name)]
    values, marks = _unlow(col("vals"), width), _unlow(col("marks"), width)
    order = np.concatenate([values, marks, marks])
    order.sort()
    again = np.zeros(len(order), bool)
    again[1:] = order[1:] == order[:-1]
    again[1:] &= ~again[:-1]  # the second of each run
    shared = order[again]
    del order, again, marks
    hit = np.zeros(len(values), bool)
    for lo in range(0, len(values) if len(shared) else 0, SLICE):
        some = values[lo : lo + SLICE]
        hit[lo : lo + SLICE] = shared[np.minimum(np.searchsorted(shared, some), len(shared) - 1)] == some
    joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *[_unplanes(x, kind) for x in col(name)]])
    many = joined("many", np.uint32).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(many)])
    total = np.concatenate([[0], np.cumsum(hit)])
    found = total[upto[1:]] - total[upto[:-1]]
    del total, upto
    ids = np.concatenate([joined("ids", np.int64)[found > 0], joined("told", np.int64)])
    counts = np.concatenate([found[found > 0], joined("known", np.uint32).astype(np.int64)])
    held = np.concatenate([values[hit], _unlow(col("sure"), 8)]) if width == 8 else values[:0]
    part = (_batch.mix(ids.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % parts
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    pieces = [by[cuts[k] : cuts[k + 1]] for k in full]
    listed = [b""] * len(full)
    if width == 8:
        owner = np.repeat(part, counts)
        listed = [_low(held[owner == k], 8) for k in full] if len(full) < 64 else [x.tobytes() for x in np.split(held[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=parts))[:-1]) if len(x)]
    packed = lambda x: [_planes(x[p]) for p in pieces]
    return pa.table({"part": pa.array(full, pa.int64()), "ids": pa.array(packed(ids), pa.binary()), "counts": pa.array(packed(counts), pa.binary()), "vals": pa.array(listed, pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    """A row an id, from the packed counts of all buckets."""
    ids, counts = (np.concatenate([_unplanes(x.as_py(), np.int64) for x in table.column(c)]) for c in ("ids", "counts"))
    names, place = np.unique(ids, return_inverse=True)
    return pa.table({"id": names, "shared": np.bincount(place, counts, len(names)).astype(np.int64)})


def _listed(table: pa.Table) -> pa.Table:
    """A row an id with its shared values."""
    ids, counts = (np.concatenate([_unplanes(x.as_py(), np.int64) for x in table.column(c)]) for c in ("ids", "counts"))
    values = _unlow([x.as_py() for x in table.column("vals")], 8)
    owner = np.repeat(ids, counts)
    by = np.argsort(owner, kind="stable")
    names, many = np.unique(owner, return_counts=True)
    at = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int64))
    return pa.table({"id": names, "values": pa.LargeListArray.from_arrays(at, pa.array(values[by].view(np.int64))).cast(pa.list_(pa.int64()))})


_PACKED = "bucket long, ids binary, many binary, vals binary, marks binary, told binary, known binary, sure binary"


def _dealt(df: DataFrame, sets: Callable[[pa.RecordBatch], Sets], total: int, width: int) -> DataFrame:
    buckets, parts = max(1, -(-total // PER_BUCKET)), max(4, -(-total // PER_PART))

    def run(batches):
        held: list[tuple] = []
        many = 0
        for batch in batches:
            for ids, sizes, values in sets(batch):
                held.append((ids, sizes, values))
                many += len(values)
                if many >= CHUNK:
                    yield _chunk(*map(np.concatenate, zip(*held, strict=True)), buckets, width)
                    held, many = [], 0
        if many:
            yield _chunk(*map(np.concatenate, zip(*held, strict=True)), buckets, width)

    packed = df.mapInArrow(run, _PACKED)
    return packed.groupBy("bucket").applyInArrow(lambda t: _counted(t, parts, width), "part long, ids binary, counts binary, vals binary")


def shared_counts(df: DataFrame, sets: Callable[[pa.RecordBatch], Sets], total: int) -> DataFrame:
    """(id, shared): how many values of the sets with this id stand in another set too, or a little more.

    ``total``: about how many values there are. Two values that agree in their bucket and WIDTH bytes count as one.
    """
    return _dealt(df, sets, total, WIDTH).groupBy("part").applyInArrow(_summed, "id long, shared long")


def shared_lists(df: DataFrame, sets: Callable[[pa.RecordBatch], Sets], total: int) -> DataFrame:
    """(id, values): the values of the sets with this id that stand in another set too."""
    return _dealt(df, sets, total, 8).groupBy("part").applyInArrow(_listed, "id long, values array<long>")
