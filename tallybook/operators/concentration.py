"""How far a book depends on few debtors or assignors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallybook.functions import ratio, total, units


def _per_debtor(receivables: DataFrame) -> DataFrame:
    return receivables.groupBy("debtor").agg(F.sum("face_cents").alias("face_cents"))


def largest_debtors(receivables: DataFrame, n: int = 10) -> DataFrame:
    """``rank, debtor, face_value, share``: the ``n`` largest by face value, ties by debtor.

    ``orderBy().limit()`` keeps the best ``n`` of each partition and merges those, so
    only ``n`` rows meet in one place; the rank is taken over them alone. The book's
    total is a scalar subquery over the same per-debtor sums, whose shuffle is reused.
    """
    per_debtor = _per_debtor(receivables)
    book = per_debtor.select(total("face_cents").alias("book")).scalar()
    order = [F.col("face_cents").desc(), F.col("debtor").asc_nulls_last()]
    return (
        per_debtor.orderBy(*order)
        .limit(n)
        .select(
            F.row_number().over(Window.orderBy(*order)).alias("rank"),
            "debtor",
            units("face_cents").alias("face_value"),
            ratio(units("face_cents"), book).alias("share"),
        )
    )


def debtor_concentration(receivables: DataFrame, debtors: DataFrame) -> DataFrame:
    """``segment, n_debtors, face_value, herfindahl``: sum of squared debtor shares per segment.

    Written as the sum of squares over the square of the sum, which needs neither the
    segment totals first nor a join back to them. The debtor's rows are summed before
    the join, so the join meets one row per debtor. Debtors without a customer row make up
    the row of the null segment, so that the segments add up to the book.
    """
    value = F.col("face_cents").cast("double")
    return (
        _per_debtor(receivables)
        .join(debtors, "debtor", "left")
        .groupBy("segment")
        .agg(
            F.count("*").alias("n_debtors"),
            total("face_cents").alias("face_value"),
            ratio(F.sum(value * value), F.sum(value) * F.sum(value)).alias("herfindahl"),
        )
    )


def assignor_rollup(lines: DataFrame, assignors: DataFrame, nations: DataFrame) -> DataFrame:
    """``region, nation, level, n_lines, line_value``: with subtotals per region and overall.

    ``level`` is 0 for a nation, 1 for a region, 3 for the whole. Lines are summed per
    assignor before the join and per nation before the rollup, so that the rollup
    multiplies a handful of rows and no busy assignor reaches the join as more than one.
    """
    per_assignor = lines.groupBy("assignor").agg(
        F.count("*").alias("n_lines"), F.sum("line_cents").alias("line_cents")
    )
    per_nation = (
        per_assignor.join(assignors, "assignor", "left")
        .groupBy("nation_key")
        .agg(F.sum("n_lines").alias("n_lines"), total("line_cents").alias("line_value"))
    )
    return (
        per_nation.join(nations, "nation_key", "left")
        .rollup("region", "nation")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n_lines").alias("n_lines"),
            F.sum("line_value").alias("line_value"),
        )
    )
