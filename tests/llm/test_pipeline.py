import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import secrets
from millrace.llm._spark import written

from test_ops import brute_components  # isort: skip


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], SMALL)))
    for table in steps[1:-1]:
        assert table.columns == docs.columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in steps]
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & ids[1]) >= 0.97 * len(clean)
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids[2] == {i for i, (_, root) in brute_components(rows).items() if i == root}
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in steps[2:4])
    for i, text in before.items():
        found = secrets.spans_of(text)
        assert after[i] == secrets.masked(text, found, "[SECRET]") and (found or after[i] == text)
    assert len(clean & ids[4]) >= 0.95 * len(clean & ids[3]) and ids[4] <= ids[3]
    assert ids[5] == ids[4]
    last = {r.doc_id: r for r in steps[5].collect()}
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in last.values())
    kept = {r.doc_id: r.s for r in steps[4].select("doc_id", F.sha2("text", 256).alias("s")).collect()}
    assert all(r.decoded_sha256 == kept[i] for i, r in last.items())


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
