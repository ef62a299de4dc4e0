"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from tallybook import sources
from tallybook.operators import lines
from tallybook.plans import QUERIES

BATCH = [name for name in QUERIES if name != "streamed_daily_events"]


@pytest.fixture
def plan_of(spark, tables):
    """The plan of a query with small-table broadcasts off, as at scale."""

    def plan(name: str) -> str:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            frame = QUERIES[name](spark, tables)
            return frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return plan


def read_columns(plan: str) -> dict[str, set[str]]:
    """Columns read by each scan, by table; scans of one table must agree or be listed by the widest."""
    scans: dict[str, set[str]] = {}
    for table, schema in re.findall(r"/(\w+)\.parquet\].*?ReadSchema: struct<([^>]*)>", plan):
        scans.setdefault(table, set()).update(c.split(":")[0] for c in schema.split(",") if c)
    return scans


@pytest.mark.parametrize("name", BATCH)
def test_no_product_no_nested_loop_no_python(plan_of, name):
    plan = plan_of(name)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ExistingRDD"):
        assert unwanted not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("monthly_origination", {"orders": {"o_orderdate", "o_totalprice"}}),
        ("age_buckets", {"orders": {"o_orderdate", "o_totalprice", "o_orderstatus"}}),
        ("band_rates", {"orders": {"o_totalprice"}}),
        ("largest_debtors", {"orders": {"o_custkey", "o_totalprice"}}),
        (
            "return_rate_by_segment",
            {
                "lineitem": {"l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"},
                "orders": {"o_orderkey", "o_custkey"},
                "customer": {"c_custkey", "c_mktsegment"},
            },
        ),
        ("activity_sessions", {"events": {"ts", "user_id"}}),
    ],
)
def test_scans_read_only_what_is_used(plan_of, name, columns):
    assert read_columns(plan_of(name)) == columns


def test_open_status_is_filtered_in_the_scan(plan_of):
    assert re.search(r"PushedFilters: \[[^\]]*Not\(EqualNullSafe\(o_orderstatus,F\)\)", plan_of("age_buckets"))


def test_top_debtors_are_not_sorted_as_a_whole(plan_of):
    plan = plan_of("largest_debtors")
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "rangepartitioning" not in plan


def test_book_total_reuses_the_debtor_shuffle(spark, tables):
    frame = QUERIES["largest_debtors"](spark, tables)
    frame.collect()
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


# Shuffles by hash: none beyond the keys each query has to meet on.
@pytest.mark.parametrize(
    "name, shuffles",
    [
        ("monthly_origination", 1),
        ("age_buckets", 1),
        ("band_rates", 1),
        ("debtor_concentration", 3),  # debtors' sums, debtors, segments
        ("origination_cohorts", 3),  # debtor and month, debtor, cohort
        ("header_line_check", 3),  # lines' sums, receivables, outcomes
        ("return_rate_by_segment", 5),  # lines' sums, receivables, debtors' sums, debtors, segments
        ("activity_sessions", 2),  # user and tumbling window, user
        ("weekly_state", 2),  # user and slot, user
    ],
)
def test_number_of_shuffles(plan_of, name, shuffles):
    assert plan_of(name).count("Exchange hashpartitioning") == shuffles


# The plan of age_buckets prints its scalar subquery between the aggregate and the exchange.
@pytest.mark.parametrize("name", [name for name in BATCH if name != "age_buckets"])
def test_aggregates_start_before_the_first_shuffle(plan_of, name):
    """An exchange under a final aggregate, with no exchange below it, stands on a partial one."""
    lines = [
        line
        for line in plan_of(name).splitlines()
        if re.search(r"[A-Z]\w+", line) and not re.match(r"[\W\d]*(Sort|Project) ", line)
    ]
    depth = [re.search(r"[A-Z*]", line).start() for line in lines]
    found = 0
    for place, line in enumerate(lines):
        parent = next((n for n in range(place - 1, -1, -1) if depth[n] < depth[place]), place)
        if "Exchange hashpartitioning" not in line or "Aggregate" not in lines[parent]:
            continue
        end = next((n for n in range(place + 1, len(lines)) if depth[n] <= depth[place]), len(lines))
        if any("Exchange" in below for below in lines[place + 1 : end]):
            continue
        assert re.search(r"Aggregate\(keys?=\[[^]]*\], functions=\[(partial_|\])", lines[place + 1])
        found += 1
    assert found


def test_tables_bucketed_by_receivable_are_joined_in_place(spark, tables, rows_of):
    """Lines and orders bucketed by order key need no shuffle to meet, and give the same."""
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        frame = sources.read_table(spark, tables, table)
        frame.write.mode("overwrite").bucketBy(4, key).sortBy(key).saveAsTable(f"bucketed_{table}")
    receivables = sources.receivables(spark.table("bucketed_orders"))
    order_lines = sources.order_lines(spark.table("bucketed_lineitem"))
    result = lines.header_line_check(receivables, order_lines)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = result._jdf.queryExecution().executedPlan().toString()
        found = rows_of(result)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.findall(r"hashpartitioning\((\w+)#", plan) == ["_groupingexpression"]
    assert found == rows_of(QUERIES["header_line_check"](spark, tables))
