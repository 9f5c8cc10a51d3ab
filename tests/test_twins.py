"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.catalog import QUERIES

FOLDER = os.environ.get("KEYSIFT_TEST_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


def test_every_query_has_a_twin():
    assert QUERIES.keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    assert got == want
