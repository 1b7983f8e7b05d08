"""Every registered query of the engine against its SQL."""

import pytest
from compare import duck, same
from compare import SF

from tidewater.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con.sql(catalogue.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
