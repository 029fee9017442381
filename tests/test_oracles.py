"""Every query with SQL gives the SQL's rows."""

import pytest

from lodegraph.queries import ORACLES, QUERIES
from tests.compare import same, views
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node_id", "support", "min_hops"]
    assert set(e.oracle_sql()) <= set(e.queries())
