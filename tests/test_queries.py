"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_query(spark, tables, name):
    found = entries.queries()[name](spark, FOLDER)
    rows = found.collect()
    assert rows
    if name in entries.oracle_sql():
        cursor = tables.execute(entries.oracle_sql()[name])
        columns = [column[0] for column in cursor.description]
        assert sorted(columns) == sorted(found.columns)
        assert as_rows(found.columns, rows) == as_rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["topk_lsh_recall", "topk_lists_recall"])
def test_recall(spark, name):
    rows = entries.queries()[name](spark, FOLDER).collect()
    assert sum(row.n_found for row in rows) / sum(row.n_exact for row in rows) >= 0.9


def test_entry(spark):
    assert entries.entry(spark).count() > 0
