"""Operators that split busy keys, against plain per-key computations on skewed rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallybook.operators import asof, sessions, transitions

START = datetime(2024, 1, 1)
SCHEMA = "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string"


def skewed_rows(seed: int, n: int = 3000):
    """A third of the rows on one key, a tenth on the null key, equal times, null states."""
    draw = random.Random(seed)
    rows = []
    for number in range(n):
        user = draw.choices([0, None, draw.randint(1, 60)], [0.33, 0.1, 0.57])[0]
        seconds = draw.choice([draw.randint(0, 40 * 86400), draw.randint(0, 40) * 86400, 5000])
        state = draw.choice(["a", "b", "c", None])
        rows.append((user, START + timedelta(seconds=seconds), number, state))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def skewed(request, spark):
    rows = skewed_rows(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def by_user(rows):
    users: dict = {}
    for row in sorted(rows, key=lambda row: (row[1], row[2])):
        users.setdefault(row[0], []).append(row)
    return users


@pytest.mark.parametrize("hot_rows", [0, 40, 200, 10_000])
@pytest.mark.parametrize("stretch_seconds", [1, 3600, 10**9])
def test_pairs_are_those_of_lag(skewed, hot_rows, stretch_seconds):
    rows, frame = skewed
    expected = Counter(
        (before[3], after[3])
        for ordered in by_user(rows).values()
        for before, after in zip(ordered, ordered[1:])
    )
    pairs = transitions.consecutive_pairs(
        frame, "user_id", "ts", "event_id", "event_type", hot_rows, stretch_seconds
    )
    assert Counter(tuple(row) for row in pairs.collect()) == expected


def test_rows_without_a_time_come_first(spark):
    rows = [(1, None, 2, "b"), (1, None, 1, "a"), (1, START, 3, "c"), (2, None, 4, "d")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in (0, 10):
        pairs = transitions.consecutive_pairs(
            frame, "user_id", "ts", "event_id", "event_type", hot_rows
        )
        assert sorted(tuple(row) for row in pairs.collect()) == [("a", "b"), ("b", "c")]


def test_transition_shares(spark, rows_of):
    pairs = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), (None, "a")], "from_state string, to_state string"
    )
    assert rows_of(transitions.transition_matrix(pairs)) == [
        (None, "a", 1, 1.0),
        ("a", "b", 2, 0.66666667),
        ("a", "c", 1, 0.33333333),
        ("b", "a", 1, 1.0),
    ]


def test_hot_keys_are_few_for_any_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(transitions, "MAX_HOT_GROUPS", 3)
    keys = [key for key in range(10) for _ in range(10)] + [99] * 50
    frame = spark.createDataFrame([(key,) for key in keys], "key bigint")
    assert [row[0] for row in transitions.hot_keys(frame, 0)[0].collect()] == []
    more = frame.union(spark.createDataFrame([(99,)] * 50, "key bigint"))
    assert [row[0] for row in transitions.hot_keys(more, 0)[0].collect()] == [99]


@pytest.mark.parametrize("gap_hours", [1, 6, 30])
def test_sessions_are_those_of_session_window(skewed, rows_of, gap_hours):
    _, frame = skewed
    gap = timedelta(hours=gap_hours)
    expected = frame.groupBy("user_id", F.session_window("ts", f"{gap_hours} hours")).count()
    assert rows_of(sessions.sessions(frame, "user_id", "ts", gap)) == rows_of(
        expected, "user_id", "session_window.start", "count"
    )


@pytest.mark.parametrize("step_days, periods", [(7, 5), (1, 45), (10, 1)])
def test_states_are_those_of_a_search(skewed, rows_of, step_days, periods):
    rows, frame = skewed
    first = date(2024, 1, 3)
    expected = []
    for user, ordered in by_user(rows).items():
        for number in range(periods):
            day = first + timedelta(days=number * step_days)
            before = [row for row in ordered if row[1] <= datetime.combine(day, datetime.min.time())]
            expected.append((user, day, before[-1][3] if before else None))
    found = asof.state_as_of(
        frame, "user_id", "ts", "event_id", ["event_type"], first, step_days, periods
    )
    order = lambda row: tuple((value is not None, value) for value in row)
    assert rows_of(found) == sorted(expected, key=order)


@pytest.fixture(scope="module")
def busy(spark):
    """Half of 200,000 rows on one key, spread over two days and eight partitions."""
    number = F.col("id")
    return spark.range(0, 200_000, 1, 8).select(
        F.when(number % 2 == 0, 0).otherwise(number % 1009).cast("bigint").alias("user_id"),
        F.timestamp_add("second", number % (2 * 86400), F.lit(START)).cast("timestamp_ntz").alias("ts"),
        number.alias("event_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (number % 7 % 3 + 1).cast("int")).alias(
            "event_type"
        ),
    )


def test_sums_not_rows_of_a_busy_key_are_shuffled(busy, shuffles_of):
    one = busy.where("user_id = 0")
    found = sessions.sessions(one, "user_id", "ts", timedelta(hours=6))
    assert sum(row[2] for row in found.collect()) == one.count()
    # Eight tumbling windows in two days: at most that many rows from each of eight tasks.
    assert all(rows <= 8 * 8 for _, rows, _ in shuffles_of(found))
    states = asof.state_as_of(
        one, "user_id", "ts", "event_id", ["event_type"], date(2024, 1, 1), 1, 4
    )
    assert all(rows <= 8 * 5 for _, rows, _ in shuffles_of(states))


def test_a_hot_key_is_spread_over_the_partitions(busy, shuffles_of):
    def largest_part(hot_rows, frame=busy):
        pairs = transitions.consecutive_pairs(
            frame, "user_id", "ts", "event_id", "event_type", hot_rows
        )
        [sizes] = [sizes for _, rows, sizes in shuffles_of(pairs) if rows == 200_000]
        return max(sizes) / sum(sizes)

    assert largest_part(10**9) > 0.5  # kept whole
    assert largest_part(10_000) < 0.2  # an even part is an eighth
    # All of the key's events at one instant, or none with a time: cut by the tiebreak.
    for moment in (START, None):
        at_once = busy.withColumn("ts", F.lit(moment).cast("timestamp_ntz"))
        assert largest_part(2_000, at_once) < 0.3
    # The same but for one event half a minute later, with tiebreaks bunched up, or without any.
    last = F.col("event_id") == 199_998
    spread = F.when(last, F.lit(START + timedelta(seconds=30))).otherwise(F.lit(START))
    nearly = busy.withColumn("ts", spread.cast("timestamp_ntz"))
    assert largest_part(2_000, nearly) < 0.3
    bunched = F.when(F.col("event_id") % 1000 == 0, F.col("event_id") * 10**12).otherwise(F.col("event_id"))
    assert largest_part(2_000, nearly.withColumn("event_id", bunched)) < 0.3
    # Some without a tiebreak: those share one piece.
    some = F.when(F.col("event_id") % 10 != 0, F.col("event_id"))
    assert largest_part(2_000, nearly.withColumn("event_id", some)) < 0.3
    # All within a minute: cut by the microsecond.
    micros = F.timestamp_add("microsecond", F.col("event_id"), F.lit(START))
    assert largest_part(2_000, busy.withColumn("ts", micros.cast("timestamp_ntz"))) < 0.3
