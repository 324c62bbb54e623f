"""Every registered query against the same question in SQL on another engine."""

import os

import pytest

import __spark_entry__ as entry_module
from areashare.plans.queries import build_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry_module.oracle_sql()
# The training-data queries that SQL cannot express are tested with their operators.
QUERIES = {name: query for name, query in entry_module.queries().items() if name in ORACLE}


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    yield con
    con.close()


SPARK_TYPES = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def comparable(found, columns):
    by_name = sorted(range(len(columns)), key=columns.__getitem__)
    table = [tuple(row[i] for i in by_name) for row in found]
    return sorted(table, key=lambda row: [(v is not None, str(v)) for v in row])


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys() >= build_queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    expected = oracle.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert dict(df.dtypes) == {c[0]: SPARK_TYPES[str(c[1])] for c in expected.description}
    expected_rows = expected.fetchall()
    found = df.collect()
    assert comparable(found, df.columns) == comparable(expected_rows, columns)
    if name.startswith("ordered"):
        named = [tuple(row[c] for c in columns) for row in found]
        assert named == expected_rows


def test_entry(spark):
    assert entry_module.entry(spark).count() == 694
