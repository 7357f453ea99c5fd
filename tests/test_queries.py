"""Every query of the library itself against its SQL, on the smallest tables."""

import pytest

from tests.sql_compare import same
from tracewell import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    same(spark, DATA, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_stands(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["month", "posts", "comments", "total"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
