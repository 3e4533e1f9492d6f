"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    frame, result = contract.queries()[name](spark, SF_DIR), tables.sql(contract.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert rows(frame.columns, frame.collect()) == rows(result.columns, result.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
