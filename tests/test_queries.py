"""Every named query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from triplewright.oracles import ORACLES
from triplewright.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    found = QUERIES[name](spark, FOLDER)
    cursor = oracle.execute(ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(found.columns) == columns
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = sorted(tuple(row[i] for i in order) for row in cursor.fetchall())
    assert sorted(map(tuple, found.select(*columns).collect())) == expected
    assert expected
