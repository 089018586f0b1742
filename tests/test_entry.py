import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from logharbor.catalog import all_queries
from logharbor.oracle import all_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    result = tables.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in result.description}
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in got.dtypes} == described
    order = [list(described).index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in result.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(expected, key=key)
