"""Order lines set against their orders and debtors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions import ratio, total


def return_rate_by_segment(
    lines: DataFrame, receivables: DataFrame, debtors: DataFrame
) -> DataFrame:
    """``segment, line_value, returned_value, goods_return_rate``: share of line value sent back.

    Returned goods, not credit loss. Values are summed to one row per receivable, then
    to one per debtor, each before the join on that key: the joins meet unique keys on
    both sides and reuse the aggregates' partitioning. Lines without an order and orders
    without a debtor's row make up the row of the null segment.
    """
    returned = F.when(F.col("returned"), F.col("line_cents")).otherwise(0)
    per_receivable = lines.groupBy("receivable").agg(
        F.sum("line_cents").alias("line_cents"), F.sum(returned).alias("returned_cents")
    )
    per_debtor = (
        per_receivable.join(receivables.select("receivable", "debtor"), "receivable", "left")
        .groupBy("debtor")
        .agg(
            F.sum("line_cents").alias("line_cents"),
            F.sum("returned_cents").alias("returned_cents"),
        )
    )
    return (
        per_debtor.join(debtors, "debtor", "left")
        .groupBy("segment")
        .agg(
            total("line_cents").alias("line_value"),
            total("returned_cents").alias("returned_value"),
        )
        .withColumn("goods_return_rate", ratio("returned_value", "line_value"))
    )


def header_line_check(receivables: DataFrame, lines: DataFrame) -> DataFrame:
    """``outcome, n_receivables, face_value, line_value``: face value against the sum of its lines.

    Outcomes are ``over`` (face value above the lines), ``under``, ``equal``, ``no lines`` and,
    for lines whose receivable is not in the book, ``no order``. It reports and repairs nothing.
    """
    per_receivable = lines.groupBy("receivable").agg(
        F.sum("line_cents").alias("line_cents"), F.lit(True).alias("has_lines")
    )
    outcome = (
        F.when(F.col("in_book").isNull(), "no order")
        .when(F.col("has_lines").isNull(), "no lines")
        .when(F.col("face_cents") > F.col("line_cents"), "over")
        .when(F.col("face_cents") < F.col("line_cents"), "under")
        .otherwise("equal")
    )
    return (
        receivables.select("receivable", "face_cents", F.lit(True).alias("in_book"))
        .join(per_receivable, "receivable", "full")
        .groupBy(outcome.alias("outcome"))
        .agg(
            F.count("*").alias("n_receivables"),
            F.coalesce(total("face_cents"), F.lit(0).cast("decimal(30,2)")).alias("face_value"),
            F.coalesce(total("line_cents"), F.lit(0).cast("decimal(30,2)")).alias("line_value"),
        )
    )
