"""Every query with SQL gives the rows that DuckDB gives; test_rules.py holds each other one against brute force."""

import pytest

from inspectory.plans import registry

from .oracle import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name], D)


def test_the_rest_has_rules():
    from . import test_rules

    assert set(QUERIES) - set(SQL) == set(test_rules.COVERED)


def test_no_result_is_empty_on_both_sides(con):
    """An oracle that gives no row would prove nothing."""
    empty = []
    for name, q in SQL.items():
        try:
            if not con.sql(q).limit(1).fetchall():
                empty.append(name)
        except RuntimeError as e:
            raise AssertionError(f"{name}: {e}") from e
    assert empty == []
