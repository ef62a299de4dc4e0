"""The sales tables seen as a receivables book.

A stand-in mapping: an order is a receivable (its total the face value, its date the
origination), the customer its debtor, a line's supplier the assignor. There is no
due date, payment or default in the tables, so nothing here is about lateness.

Each function takes a raw table from wherever it was read and renames, so a table's
partitioning (one bucketed by its key, say) stays usable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions import cents, discounted_cents


def receivables(orders: DataFrame) -> DataFrame:
    """``receivable, debtor, status, originated, face_cents``, one row per order."""
    return orders.select(
        F.col("o_orderkey").alias("receivable"),
        F.col("o_custkey").alias("debtor"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("originated"),
        cents("o_totalprice").alias("face_cents"),
    )


def order_lines(lineitem: DataFrame) -> DataFrame:
    """``receivable, assignor, returned, line_cents``, one row per order line, net of discount."""
    return lineitem.select(
        F.col("l_orderkey").alias("receivable"),
        F.col("l_suppkey").alias("assignor"),
        (F.col("l_returnflag") == "R").alias("returned"),
        discounted_cents("l_extendedprice", "l_discount").alias("line_cents"),
    )


def debtors(customer: DataFrame) -> DataFrame:
    """``debtor, segment``."""
    return customer.select(
        F.col("c_custkey").alias("debtor"), F.col("c_mktsegment").alias("segment")
    )


def assignors(supplier: DataFrame) -> DataFrame:
    """``assignor, nation_key``."""
    return supplier.select(
        F.col("s_suppkey").alias("assignor"), F.col("s_nationkey").alias("nation_key")
    )


def nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """``nation_key, nation, region``."""
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").alias("nation_key"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


def user_events(events: DataFrame) -> DataFrame:
    """``event_id, ts, user_id, event_type``."""
    return events.select("event_id", "ts", "user_id", "event_type")
