"""Every query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Operators of the subpackage llm have their own tests.
CORE = {n: f for m in entry._MODULES if ".llm" not in m.__name__ for n, f in m.QUERIES.items()}
SQL = {n: s for m in entry._MODULES if ".llm" not in m.__name__ for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    compare(spark, name, CORE[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_feed_is_a_batch(spark):
    from arbordelta.plans import store_queries

    assert store_queries._batch(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
