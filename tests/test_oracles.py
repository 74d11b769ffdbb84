"""Every query that has SQL gives the rows that another engine gives for it."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from tallyloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    wanted = Counter(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    assert rows == wanted
