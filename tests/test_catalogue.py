import pytest
from conftest import SMALL, rows_of, rows_of_sql

import __spark_entry__
from millrace.plans import inventory as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert rows_of(catalogue.queries()[name](spark, SMALL)) == rows_of_sql(duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "findings", "words", "density"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
