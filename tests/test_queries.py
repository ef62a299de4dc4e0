"""Every registered query against its SQL in DuckDB, and the driver's contract."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from tallybook.plans import QUERIES

NAMES = sorted(QUERIES)
USED = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


# A third of the rows on one key, some keys and amounts moved elsewhere or missing.
SKEWED = {
    "orders": """
        SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice
        ) FROM '{root}/orders.parquet'
    """,
    "lineitem": """
        SELECT * REPLACE (
            CASE WHEN hash(l_orderkey, l_extendedprice) % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey,
            CASE WHEN hash(l_partkey, l_extendedprice) % 3 = 0 THEN 11 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS l_returnflag
        ) FROM '{root}/lineitem.parquet'
    """,
    "events": """
        SELECT * REPLACE (
            CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id,
            CASE WHEN event_id % 10 < 4 THEN date_trunc('day', ts) ELSE ts END AS ts,
            CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type
        ) FROM '{root}/events.parquet'
    """,
    "supplier": "SELECT * FROM '{root}/supplier.parquet' WHERE s_suppkey <> 3",
}
SOURCES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "skewed"]


@pytest.fixture(scope="module", params=SOURCES)
def scale(request, tmp_path_factory):
    database = duckdb.connect()
    root = request.param
    if root == "skewed":
        root, plain = str(tmp_path_factory.mktemp("skewed")), "/root/testdata/sf0.001"
        for table in USED:
            rows = SKEWED.get(table, "FROM '{root}/" + table + ".parquet'").format(root=plain)
            database.sql(f"COPY ({rows}) TO '{root}/{table}.parquet'")
    for table in USED:
        database.sql(f"CREATE VIEW {table} AS FROM '{root}/{table}.parquet'")
    yield root, database
    database.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, scale, name):
    root, database = scale
    result = contract.queries()[name](spark, root)
    expected = database.sql(contract.oracle_sql()[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    found = [tuple(row[column] for column in columns) for row in result.collect()]
    places = [expected.columns.index(column) for column in columns]
    wanted = [tuple(row[place] for place in places) for row in expected.fetchall()]
    assert found
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_every_query_has_sql():
    assert set(contract.oracle_sql()) >= set(NAMES)


def test_entry_gives_rows(spark):
    result = contract.entry(spark)
    assert result.columns == ["month", "n_receivables", "face_value"]
    assert result.count() > 0


@pytest.mark.parametrize("name", [name for name in NAMES if name != "streamed_daily_events"])
def test_result_does_not_depend_on_the_session_zone(spark, tables, rows_of, name):
    query = contract.queries()[name]
    expected = rows_of(query(spark, tables))
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert rows_of(query(spark, tables)) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
