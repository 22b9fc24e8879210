"""What the tasks of op5 and of the pipeline hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _batch, _packed, bpe, suffix_dedup


def sets(n, size, seed):
    made = np.random.RandomState(seed)
    ids = np.arange(n, dtype=np.int64)
    return ids, np.full(n, size), np.concatenate([np.unique(made.randint(0, 1 << 62, 2 * size, dtype=np.uint64))[:size] for _ in ids])


def traced(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("width", [5, 8])
def test_packed_counting_is_exact(width):
    ids, sizes, values = sets(60, 50, 1)
    values = values.reshape(60, 50)
    values[1::2, :20] = values[::2, :20]  # in the same chunk
    values[30:, 20:30] = values[:30, 20:30]  # in two chunks
    halves = [_packed._chunk(ids[a:b], sizes[a:b], values[a:b].ravel(), 3, width) for a, b in ((0, 30), (30, 60))]
    table = pa.Table.from_batches(halves)
    got = {}
    for b in range(3):
        part = table.filter(pa.compute.equal(table.column("bucket"), b))
        counted = _packed._counted(part, 4, width)
        for own, counts in zip(counted.column("ids"), counted.column("counts"), strict=True):
            for i, c in zip(_packed._unplanes(own.as_py(), np.int64), _packed._unplanes(counts.as_py(), np.int64), strict=True):
                got[int(i)] = got.get(int(i), 0) + int(c)
    every, many = np.unique(values, return_counts=True)
    twice = set(every[many > 1].tolist())
    assert got == {int(i): sum(x in twice for x in values[i].tolist()) for i in ids}


def test_counting_a_bucket_holds_little():
    ids, sizes, values = sets(2_000, 150, 2)
    table = pa.Table.from_batches([_packed._chunk(ids, sizes, values, 1, 8)])
    _, most = traced(lambda: _packed._counted(table, 4, 8))
    assert most < 40 * len(values)


def test_packing_does_not_hold_a_task(spark, monkeypatch):
    ids, sizes, values = sets(30_000, 50, 3)
    rows = []

    class Frame:
        def mapInArrow(self, run, schema):
            def pieces():
                yield from (None for _ in range(1))

            rows.extend(run(pieces()))
            return self

        def groupBy(self, key):
            return self

        applyInArrow = mapped = lambda self, f, schema: self

    def by_hundreds(batch):
        for a in range(0, len(ids), 100):
            yield ids[a : a + 100], sizes[a : a + 100], values[50 * a : 50 * (a + 100)]

    _, most = traced(lambda: _packed._dealt(Frame(), by_hundreds, len(values), 8))
    assert sum(r.num_rows for r in rows) and most < 90 << 20  # of 1.5 million values


def test_arrow_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(3_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat(char(65 + id % 26), 8000)").alias("text"))
    suffix_dedup.trim(docs.limit(3))

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"])

    assert docs.mapInArrow(seen, "b long").agg(F.max("b")).first()[0] < 6 << 20
    spark.conf.set(key, "1m")
    suffix_dedup.trim(docs.limit(3))
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_another_operator_drops_the_codec():
    class Shared:
        id, value = "x", (tuple(bytes([i]) for i in range(256)), r".+")

    assert bpe._codec(Shared) is bpe._codec(Shared)
    _batch.buffers(pa.array(["a"]))
    assert not _batch.HELD
