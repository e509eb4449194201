"""Every registered query against its SQL counterpart, or for its shape."""

import pytest

from modelloom.queries import QUERIES, SQL
from tests.conftest import DATA


def plain(value):
    if value is None:
        return "NULL"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
