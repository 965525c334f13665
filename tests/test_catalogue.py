"""Every registered query against its SQL on the smallest tables, compared as multisets."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalogue, further, lakes, sources  # noqa: F401  (register their queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert name in catalogue.ORACLES
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = Counter(tuple(plain(row[columns.index(c)]) for c in order) for row in result.fetchall())
    found = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    assert found == expected
