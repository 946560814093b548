"""Every registered query against its SQL twin."""

import duckdb
import pandas as pd
import pytest

from candela import queries as market

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value if isinstance(value, bool | int) else str(value)


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(market.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    found = market.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(market.SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    a, b = rows(found), rows(want)
    assert len(a) == len(b)
    assert [[float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r] for r in a] == [[float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r] for r in b]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(market.QUERIES) <= set(__spark_entry__.queries())
