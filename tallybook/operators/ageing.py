"""Open positions by age since origination."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions import total, whole_days

# Upper ends, in days, of all buckets but the last.
DEFAULT_ENDS = (30, 90, 180, 360)
CLOSED_STATUS = "F"


def bucket_names(ends: Sequence[int]) -> list[str]:
    """``0-30, 31-90, ..., 361+`` for ends ``30, 90, ...``."""
    starts = [0, *(end + 1 for end in ends)]
    return [f"{start}-{end}" for start, end in zip(starts, ends)] + [f"{starts[-1]}+"]


def age_buckets(
    receivables: DataFrame, as_of: date | Column, ends: Sequence[int] = DEFAULT_ENDS
) -> DataFrame:
    """``bucket, n_open, face_value`` of positions not closed, by days since origination.

    This is age at ``as_of``, not lateness. Positions originated later and positions
    without a date get buckets of their own instead of vanishing; one without a status is open.
    """
    age = whole_days("originated", F.lit(as_of))  # a Column stays one
    names = bucket_names(ends)
    number: Column = F.when(age.isNull(), len(names) + 1).when(age < 0, len(names))
    for position, end in enumerate(ends):
        number = number.when(age <= end, position)
    labels = F.array(*(F.lit(name) for name in [*names, "later", "undated"]))
    return (
        receivables.where(~F.col("status").eqNullSafe(CLOSED_STATUS))
        .groupBy(number.otherwise(len(ends)).alias("number"))
        .agg(F.count("*").alias("n_open"), total("face_cents").alias("face_value"))
        .select(F.get(labels, F.col("number")).alias("bucket"), "n_open", "face_value")
    )
