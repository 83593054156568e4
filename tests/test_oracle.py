"""Every registered query against its SQL, on the smallest supplied tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from orderlens import catalog, oracle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL_TYPES = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_each_query_has_sql():
    assert catalog.REPORTS.keys() == oracle.statements().keys()
    assert catalog.REPORTS.keys() <= driver.queries().keys()


def test_entry(spark):
    assert driver.entry(spark).count() == 6


def compare(spark, database, name):
    found = driver.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    result = database.execute(driver.oracle_sql()[name])
    types = {c[0]: str(c[1]).upper() for c in result.description}
    assert sorted(types) == columns
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in found.schema} == types
    names = list(types)
    expected = ordered(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    rows = ordered(tuple(row[c] for c in columns) for row in found.collect())
    assert rows == expected
    assert not any(isinstance(v, float) and math.isnan(v) for row in rows for v in row)


@pytest.mark.parametrize("name", list(catalog.REPORTS))
def test_equals_sql(spark, database, name):
    compare(spark, database, name)


LARGE = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.mark.parametrize(
    "name",
    ["customer_perf", "pareto_top20", "salesperson_rank", "dq_summary", "dq_id_pages", "dq_affected_rows", "describe_numeric", "kpi_headline", "preview", "clean"],
)
def test_equals_sql_by_the_plans_of_large_tables(spark, database, name):
    """Many partitions and no broadcast by size, as where tables are large."""
    before = {key: spark.conf.get(key) for key in LARGE}
    try:
        for key, value in LARGE.items():
            spark.conf.set(key, value)
        compare(spark, database, name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
