"""The queries that SQL can say, against DuckDB; the others run and keep their columns."""

import pytest
from compare import duck, same

from tidewater.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SMALL), duck(SMALL).sql(ORACLES[name]))
