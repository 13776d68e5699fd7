"""Every registered query against its SQL on the smallest tables, and the same rows for other partition counts."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from vacancia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="the driver's tables are absent")


def plain(value):
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["jobs_my_page", "breaker_skips", "scores_bulk_upsert", "candidates_cap", "rate_observations", "plan_budgeted", "geo_city_resolve"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        frame = catalogue.QUERIES[name](spark, SF)
        found.append(rows_of(frame.columns, frame.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
