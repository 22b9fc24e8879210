import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import udfs


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("Lost heading\n\n### Rule\n\nbody", "## Lost heading\n\n### Rule\n\nbody", 1),
        ("## Here\n\nLost heading\n\n### Rule", "## Here\n\nLost heading\n\n### Rule", 0),
        ("Lost heading\n\nno deeper one", "Lost heading\n\nno deeper one", 0),
        ("### Not this\n\nAn example line\n\nLost heading\n", "### Not this\n\nAn example line\n\n## Lost heading\n", 1),
        ("### R\n\nEnds with a stop.\n\nlower case\n\n- Item\n\n[Link](x)\n\nOne. Two\n\nGloss [some words]\n", None, 0),
        ("### R\n\n```\n\nIn a fence\n\n```\n", None, 0),
        ("### R\ntight line\nAnother\n", None, 0),
        ("### R\n\n" + "W" * 121 + "\n", None, 0),
    ],
)
def test_repaired(text, want, n):
    assert udfs.repaired(text) == (want or text, n)
    assert udfs.repaired(udfs.repaired(text)[0])[1] == 0


def test_columns(spark):
    df = spark.createDataFrame([(" One é. Two!’ …", ), (None,), ("",)], "t string")
    got = df.select(udfs.sentence_spans("t").alias("s"), udfs.repair_headings("t").alias("r"), F.transform(X.sentences(F.col("t")), lambda x: x).alias("n"), "t").collect()
    for r in got:
        assert all(r.t[s.start : s.end] == s.text for s in r.s)
        assert [s.text for s in r.s] == (r.n or [])
