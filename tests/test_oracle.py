"""Every registered query against its oracle statement."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normalized
from tallywind.plans.catalog import CATALOG

# Queries that other parts of the repository add to the contract have their own tests.
QUERIES = {name: item.build for name, item in CATALOG.items()}
ORACLES = {name: item.oracle for name, item in CATALOG.items() if item.oracle is not None}


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normalized(df.columns, rows) == normalized(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns[:2] == ["sender_country", "receiver_country"]


def test_few_queries_without_oracle():
    assert set(QUERIES) - set(ORACLES) == {"v7_commit_history"}


def test_contract_holds_the_catalog():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
