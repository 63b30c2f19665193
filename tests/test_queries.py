"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import pytest
from oracle_check import compare, duck

from curaspark.plans.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    if name in all_oracles():
        assert compare(df, con, all_oracles()[name]) in (None, "both results are empty")
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["model", "dataset", "accuracy", "base_accuracy", "delta", "trend"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
