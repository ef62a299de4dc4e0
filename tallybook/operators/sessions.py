"""Activity sessions separated by gaps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F


def sessions(rows: DataFrame, key: str, time: str, gap: timedelta) -> DataFrame:
    """``{key}, session_start, n_events``, the same sessions as ``session_window`` gives.

    Two rows of a key less than a gap apart are in one session, so all rows in one
    tumbling window as wide as the gap are. Rows are therefore first summed to such
    windows, partly before the shuffle, and only the sums are put in order: a key has
    at most (time span / gap) of them, however many rows it holds. Rows without a
    time are in no session.
    """
    width = f"{gap // timedelta(microseconds=1)} microseconds"
    tumbled = rows.groupBy(key, F.window(time, width).start.alias("tumble")).agg(
        F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count("*").alias("n_events")
    )
    timeline = Window.partitionBy(key).orderBy("earliest")
    silence = F.col("earliest") - F.lag("latest").over(timeline)
    # The first row's silence is null, which also opens a session.
    opens = F.when(silence <= F.lit(gap), 0).otherwise(1)
    return (
        tumbled.select(key, "earliest", "n_events", opens.alias("opens"))
        .withColumn(
            "session", F.sum("opens").over(timeline.rowsBetween(Window.unboundedPreceding, 0))
        )
        .groupBy(key, "session")
        .agg(F.min("earliest").alias("session_start"), F.sum("n_events").alias("n_events"))
        .drop("session")
    )
