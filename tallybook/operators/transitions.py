"""Transitions between consecutive states of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.functions import epoch_micros, epoch_seconds, ratio

# A group is hot above this many rows, and above this part of all rows.
HOT_ROWS = 5_000_000
MAX_HOT_GROUPS = 100_000
STRETCH_SECONDS = 60
# Parts a crowded stretch is cut into. A constant: quantiles have to be.
PIECES = 64
# Stands for a missing time or tiebreak, below all others.
NO_VALUE = -(2**62)


def hot_keys(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, Column]:
    """``key, is_hot`` of keys above a number of rows, and that number.

    It is ``hot_rows`` or 1/100,000 of all rows, whichever is more. So there are never more
    than 100,000 groups above it, which can be broadcast for any number of rows.
    """
    counted = rows.groupBy("key").agg(F.count("*").alias("n_rows"))
    part = counted.select((F.sum("n_rows") / MAX_HOT_GROUPS).alias("part")).scalar()
    limit = F.greatest(F.lit(hot_rows).cast("double"), part)
    return counted.where(F.col("n_rows") > limit).select("key", F.lit(True).alias("is_hot")), limit


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Add the groups' other columns to their rows. Null keys form groups like any others."""
    renamed = groups.withColumnsRenamed({key: f"hot_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"hot_{key}")) for key in keys]
    return rows.join(F.broadcast(renamed), same, "left").drop(*(f"hot_{key}" for key in keys))


def _time() -> Column:
    """The row's time as a number; rows without one come first."""
    return F.coalesce(epoch_micros("time"), F.lit(NO_VALUE)).cast("double")


def _tiebreak() -> Column:
    return F.coalesce(F.col("tiebreak").cast("double"), F.lit(float(NO_VALUE)))


def _cuts(value: Column) -> Column:
    """Aggregate: points that leave at most about 1 / PIECES of the rows between two of them."""
    shares = F.array(*(F.lit(number / PIECES) for number in range(1, PIECES)))
    return F.array_distinct(F.percentile_approx(value, shares, 20 * PIECES))


def _piece() -> Column:
    """Number of a row's piece of a crowded stretch, in the order of (``time``, ``tiebreak``).

    Pieces lie between the cuts of the stretch's times, whatever their distribution. An instant that
    is a cut itself may hold any number of rows, so it is cut again by the tiebreaks' cuts;
    those are of the whole stretch, so no part of any instant holds more than 1 / PIECES of it.
    """
    time, tiebreak = _time(), _tiebreak()
    before = F.size(F.filter("time_cuts", lambda cut: cut < time))
    at_cut = F.array_contains("time_cuts", time)
    part = F.size(F.filter("tiebreak_cuts", lambda cut: cut <= tiebreak))
    return (2 * before + at_cut.cast("int")) * PIECES + F.when(at_cut, part).otherwise(0)


def _ends(rows: DataFrame, *keys: str, cuts: bool = False) -> DataFrame:
    """``keys, n_rows, first, last``: the first and last row of each group, and its cuts."""
    row = F.struct("time", "tiebreak", "state")
    more = (
        [_cuts(_time()).alias("time_cuts"), _cuts(_tiebreak()).alias("tiebreak_cuts")]
        if cuts
        else []
    )
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(row).alias("first"), F.max(row).alias("last"), *more
    )


def _seams(ends: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs across one group and the next of the same ``keys``."""
    return (
        # Asking for the count keeps the aggregate the one that crowded stretches are
        # taken from, so that its shuffle is reused.
        ends.where(F.col("n_rows") > 0)
        .select(F.lag("last").over(Window.partitionBy(*keys).orderBy(order)).alias("before"), "first")
        .where(F.col("before").isNotNull())
        .select(F.col("before.state").alias("from_state"), F.col("first.state").alias("to_state"))
    )


def consecutive_pairs(
    rows: DataFrame,
    key: str,
    time: str,
    tiebreak: str,
    state: str,
    hot_rows: int = HOT_ROWS,
    stretch_seconds: int = STRETCH_SECONDS,
) -> DataFrame:
    """``from_state, to_state``: each row's state after the row before it of the same key.

    The same pairs as ``lag(state)`` over the key ordered by (``time``, ``tiebreak``),
    without sorting a key that holds a large part of all rows in one task. Hot keys are cut
    into stretches of time, stretches that are hot themselves into pieces, and rows are
    ordered within those; the pairs across two of them come from the first and last row of
    each. Other keys stay whole, so they are shuffled once. ``time`` is a
    ``timestamp_ntz`` and ``tiebreak`` a number.
    """
    narrow = rows.select(
        F.col(key).alias("key"),
        F.col(time).alias("time"),
        F.col(tiebreak).alias("tiebreak"),
        F.col(state).alias("state"),
    )
    hot, limit = hot_keys(narrow, hot_rows)
    stretch = F.floor(epoch_seconds("time") / stretch_seconds)
    stretched = _with_groups(narrow, hot, ["key"]).withColumn(
        "stretch", F.when(F.col("is_hot"), stretch)
    )
    stretches = _ends(stretched.where("is_hot"), "key", "stretch", cuts=True)
    crowded = stretches.where(F.col("n_rows") > limit)
    cut = _with_groups(stretched, crowded, ["key", "stretch"]).withColumn(
        "piece", F.when(F.col("n_rows").isNotNull(), _piece())
    )
    pieces = _ends(
        cut.where(F.col("n_rows").isNotNull()).drop("n_rows"), "key", "stretch", "piece"
    )

    together = Window.partitionBy("key", "stretch", "piece").orderBy("time", "tiebreak")
    within = (
        cut.select(
            F.lag("state").over(together).alias("from_state"),
            # Renamed only after the window, or the shuffle would carry the state twice.
            "state",
            # States may be null; a missing row before is told by a constant.
            F.lag(F.lit(True)).over(together).alias("has_before"),
        )
        .where("has_before")
        .select("from_state", F.col("state").alias("to_state"))
    )
    return within.unionByName(_seams(stretches, ["key"], "stretch")).unionByName(
        _seams(pieces, ["key", "stretch"], "piece")
    )


def transition_matrix(pairs: DataFrame) -> DataFrame:
    """``from_state, to_state, n_transitions, share``, the share being of the from-state."""
    counted = pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n_transitions"))
    leaving = F.sum("n_transitions").over(Window.partitionBy("from_state"))
    return counted.withColumn("share", ratio(F.col("n_transitions"), leaving))
