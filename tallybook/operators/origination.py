"""Origination over calendar months: volumes, trailing sums, debtor cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallybook.functions import month_number, month_of, total


def by_month(receivables: DataFrame) -> DataFrame:
    """``month, n_receivables, face_value``."""
    return receivables.groupBy(month_of("originated").alias("month")).agg(
        F.count("*").alias("n_receivables"), total("face_cents").alias("face_value")
    )


def trailing(monthly: DataFrame, months: int = 12) -> DataFrame:
    """``month, face_value, previous_month, trailing_value`` (the month and those before it).

    Frames range over the month number, so a month without rows counts as empty
    instead of stretching the frame further back. The window has no partition key:
    it holds one row per calendar month, whatever the size of the book.
    """
    timeline = Window.orderBy("month_number")
    return (
        monthly.withColumn("month_number", month_number("month"))
        .select(
            "month",
            "face_value",
            F.sum("face_value").over(timeline.rangeBetween(-1, -1)).alias("previous_month"),
            F.sum("face_value").over(timeline.rangeBetween(1 - months, 0)).alias("trailing_value"),
        )
    )


def cohorts(receivables: DataFrame) -> DataFrame:
    """``cohort, months_since, active_debtors, face_value``: debtors by month of first origination.

    Receivables are first summed to one row per debtor and month, partly before the
    shuffle, so a debtor with a large part of the book adds no more rows to the
    window than it has months. Those rows are unique, so counting them counts debtors.
    """
    monthly = receivables.groupBy("debtor", month_of("originated").alias("month")).agg(
        F.sum("face_cents").alias("face_cents")
    )
    first = F.min("month").over(Window.partitionBy("debtor"))
    return (
        monthly.withColumn("cohort", first)
        .groupBy(
            "cohort", (month_number("month") - month_number("cohort")).alias("months_since")
        )
        .agg(F.count("debtor").alias("active_debtors"), total("face_cents").alias("face_value"))
    )
