"""Every registered query against its SQL, whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from blockledger.workload.queries import QUERIES
from conftest import FOLDER

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def by_name(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(entry.oracle_sql()[name])
    want = by_name([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    actions = {r["action"] for r in entry.entry(spark).select("action").distinct().collect()}
    assert actions == {"in_sync", "backup", "delete_stale", "delete_orphan", "restore"}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
