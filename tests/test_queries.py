"""Every panel query against independent SQL on the same tables."""

import pytest

from genoloom import catalogue

from .conftest import DATA

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def _rows(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})").fetchall()
    assert len(duck.sql(SQL[name]).columns) == len(columns)
    assert _rows(df.select(columns).collect()) == _rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
