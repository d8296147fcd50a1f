"""Every query against its SQL twin."""

import pytest

from brookline.plans import registry
from tests.compare import connect, same

FOLDER = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    if name in registry.ORACLES:
        same(got, duck.sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7 - 1
    assert set(e.oracle_sql()) <= set(e.queries())
