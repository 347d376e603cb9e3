"""Every registered query of the library against its SQL, and that the others give rows."""

from __future__ import annotations

import pytest
from compare import connection, differences

from revsight import queries as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):  # noqa: ANN001, ANN201
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, con, name):  # noqa: ANN001
    assert differences(QUERIES[name](spark, sf), SQL[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):  # noqa: ANN001
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):  # noqa: ANN001
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
