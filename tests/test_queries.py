"""Every query of the library against DuckDB; those without SQL must give rows."""

import pytest

import oracle
from lectern import plans
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


#: No customer is without an order at this size.
EMPTY = {"antijoin_missing_files"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    found = oracle.compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])
    assert found is None or (name in EMPTY and found == "no rows"), found


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
