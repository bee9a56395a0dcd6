"""Every query against its SQL on the smallest tables, and a defined schema for those without SQL."""

import pytest

from skilltide import oracles, oracles_flow, queries_flow
from skilltide.queries import QUERIES

from .conftest import rows_by_name

SF = "/root/testdata/sf0.001"
ORACLE_SQL = oracles.ORACLE_SQL | oracles_flow.FLOW_SQL
assert queries_flow.query


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    assert rows_by_name(found.columns, found.collect()) == duck(SF, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
