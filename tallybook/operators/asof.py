"""The state of each key at regular dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tallybook.functions import whole_days


def state_as_of(
    rows: DataFrame,
    key: str,
    time: str,
    tiebreak: str,
    values: Sequence[str],
    start: date,
    step_days: int,
    periods: int,
) -> DataFrame:
    """``{key}, as_of, {values}``: last row of each key at or before midnight of each date.

    Every key has a row for every date, with null values before its first row. Rows are
    first reduced, partly before the shuffle, to the last one per key and interval
    between dates, so a key contributes at most ``periods + 1`` rows to its window. Each
    of those rows then stands for the dates until the next, without any join.
    """
    day = whole_days(F.lit(start), time)
    past_midnight = F.col(time) > F.to_date(time).cast("timestamp_ntz")
    days_up = day + F.when(past_midnight, 1).otherwise(0)
    # The first date at or after the row. Rows after the last date, or without a time, share
    # a slot beyond it that no date reaches.
    reached_at = F.greatest(F.ceil(days_up / F.lit(step_days)), F.lit(0))
    slot = F.when(F.col(time).isNull(), periods).otherwise(F.least(reached_at, F.lit(periods)))

    latest = rows.groupBy(key, slot.cast("int").alias("slot")).agg(
        F.max(F.struct(time, tiebreak, *values)).alias("latest")
    )
    timeline = Window.partitionBy(key).orderBy("slot")
    spans = latest.select(
        key,
        "slot",
        "latest",
        F.when(F.row_number().over(timeline) == 1, 0).otherwise(F.col("slot")).alias("from_slot"),
        F.lead("slot", 1, periods).over(timeline).alias("next_slot"),
    ).where(F.col("from_slot") < F.col("next_slot"))
    dated = spans.withColumn(
        "date_slot", F.explode(F.sequence("from_slot", F.col("next_slot") - 1))
    )
    reached = F.col("date_slot") >= F.col("slot")
    return dated.select(
        key,
        F.date_add(F.lit(start), F.col("date_slot") * step_days).alias("as_of"),
        *(F.when(reached, F.col(f"latest.{value}")).alias(value) for value in values),
    )
