"""Training-data queries that SQL can express, against it."""

import pytest

from tests.sql_compare import same
from tracewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_its_sql(spark, name, sf):
    same(spark, f"/root/testdata/{sf}", queries.QUERIES[name], queries.ORACLES[name])
