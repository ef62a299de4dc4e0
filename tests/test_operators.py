"""Hand-computed cases: ties, gaps, nulls, bucket edges, empty input."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.operators import ageing, asof, bands, concentration, lines, origination, sessions

RECEIVABLES = "receivable bigint, debtor bigint, status string, originated timestamp_ntz, face_cents bigint"


def book(spark, rows):
    """Receivables from (debtor, status, date, cents)."""
    return spark.createDataFrame(
        [
            (number, debtor, status, day and datetime.combine(day, datetime.min.time()), amount)
            for number, (debtor, status, day, amount) in enumerate(rows)
        ],
        RECEIVABLES,
    )


def test_months(spark, rows_of):
    rows = [
        (1, "O", date(2020, 1, 1), 100),
        (1, "O", date(2020, 1, 31), 50),
        (2, "O", date(2020, 2, 1), 7),
        (2, "O", None, 9),
    ]
    assert rows_of(origination.by_month(book(spark, rows))) == [
        (None, 1, Decimal("0.09")),
        (date(2020, 1, 1), 2, Decimal("1.50")),
        (date(2020, 2, 1), 1, Decimal("0.07")),
    ]


def test_trailing_counts_calendar_months_across_gaps(spark, rows_of):
    monthly = spark.createDataFrame(
        [
            (date(2019, 12, 1), Decimal(1)),
            (date(2020, 1, 1), Decimal(2)),
            (date(2020, 11, 1), Decimal(4)),
            (date(2020, 12, 1), Decimal(8)),
            (date(2022, 1, 1), Decimal(16)),
        ],
        "month date, face_value decimal(30,2)",
    )
    assert rows_of(origination.trailing(monthly)) == [
        (date(2019, 12, 1), 1, None, 1),
        (date(2020, 1, 1), 2, 1, 3),
        (date(2020, 11, 1), 4, None, 7),
        (date(2020, 12, 1), 8, 4, 14),
        (date(2022, 1, 1), 16, None, 16),
    ]


def test_cohorts(spark, rows_of):
    rows = [
        (1, "O", date(2019, 12, 31), 100),
        (1, "O", date(2020, 1, 1), 10),
        (1, "O", date(2020, 1, 20), 1),
        (2, "O", date(2019, 12, 1), 1000),
        (3, "O", date(2020, 1, 5), 5),
    ]
    assert rows_of(origination.cohorts(book(spark, rows))) == [
        (date(2019, 12, 1), 0, 2, Decimal("11.00")),
        (date(2019, 12, 1), 1, 1, Decimal("0.11")),
        (date(2020, 1, 1), 0, 1, Decimal("0.05")),
    ]


def test_age_bucket_edges(spark, rows_of):
    as_of = date(2020, 12, 31)
    ages = [0, 30, 31, 90, 91, 180, 181, 360, 361, 5000, -1]
    rows = [(1, "O", as_of - timedelta(days=age), 100) for age in ages]
    rows += [(1, "P", None, 100), (1, "F", as_of, 100)]
    found = {row[0]: row[1] for row in ageing.age_buckets(book(spark, rows), as_of).collect()}
    assert found == {
        "0-30": 2, "31-90": 2, "91-180": 2, "181-360": 2, "361+": 2, "later": 1, "undated": 1,
    }


def test_largest_debtors_breaks_ties_by_debtor(spark, rows_of):
    rows = [(debtor, "O", date(2020, 1, 1), 100) for debtor in (5, 3, 4)]
    rows += [(9, "O", date(2020, 1, 1), 60), (9, "F", date(2020, 1, 2), 50), (1, "O", None, 90)]
    assert rows_of(concentration.largest_debtors(book(spark, rows), 3)) == [
        (1, 9, Decimal("1.10"), 0.22),
        (2, 3, Decimal("1.00"), 0.2),
        (3, 4, Decimal("1.00"), 0.2),
    ]


def test_herfindahl(spark, rows_of):
    rows = [(1, "O", None, 50), (1, "O", None, 25), (2, "O", None, 25), (3, "O", None, 40)]
    debtors = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "debtor bigint, segment string")
    assert rows_of(concentration.debtor_concentration(book(spark, rows), debtors)) == [
        ("a", 2, Decimal("1.00"), 0.625),
        ("b", 1, Decimal("0.40"), 1.0),
    ]


def test_rollup_keeps_unknown_assignors_apart_from_subtotals(spark, rows_of):
    sold = spark.createDataFrame(
        [(1, 1, False, 100), (2, 1, False, 10), (3, 2, False, 1), (4, 77, False, 1000)],
        "receivable bigint, assignor bigint, returned boolean, line_cents bigint",
    )
    assignors = spark.createDataFrame([(1, 10), (2, 20)], "assignor bigint, nation_key int")
    nations = spark.createDataFrame(
        [(10, "x", "north"), (20, "y", "north")], "nation_key int, nation string, region string"
    )
    assert rows_of(concentration.assignor_rollup(sold, assignors, nations)) == [
        (None, None, 0, 1, Decimal("10.00")),
        (None, None, 1, 1, Decimal("10.00")),
        (None, None, 3, 4, Decimal("11.11")),
        ("north", None, 1, 3, Decimal("1.11")),
        ("north", "x", 0, 2, Decimal("1.10")),
        ("north", "y", 0, 1, Decimal("0.01")),
    ]


BANDS = [
    bands.Band("low", Decimal(0), Decimal("1.00"), Decimal("0.5")),
    bands.Band("high", Decimal("2.00"), None, Decimal("0.125")),
]


def test_bands_are_half_open_and_keep_what_no_band_takes(spark, rows_of):
    rows = [(1, "O", None, amount) for amount in (0, 99, 100, 199, 200, 10**9, -1)]
    assert rows_of(bands.band_rates(book(spark, rows), BANDS)) == [
        (None, 3, Decimal("2.98"), None, None),
        ("high", 2, Decimal("10000002.00"), Decimal("0.125000"), Decimal("1250000.25")),
        ("low", 2, Decimal("0.99"), Decimal("0.500000"), Decimal("0.50")),
    ]


@pytest.mark.parametrize(
    "table",
    [
        [],
        [bands.Band("a", Decimal(0), Decimal(0), Decimal(1))],
        [bands.Band("a", Decimal(0), Decimal(5), Decimal(1)), bands.Band("b", Decimal(4), None, Decimal(1))],
        [bands.Band("a", Decimal(0), None, Decimal(1)), bands.Band("b", Decimal(4), None, Decimal(1))],
        [bands.Band("a", Decimal("0.001"), None, Decimal(1))],
    ],
)
def test_bad_bands_are_refused(spark, table):
    with pytest.raises(ValueError):
        bands.band_rates(book(spark, []), table)


@pytest.mark.parametrize("count", [1, 2, 101, 5000])
def test_any_number_of_bands_gives_what_a_range_join_gives(spark, rows_of, count):
    # Every third band is missing, so amounts fall between bands too.
    table = [
        bands.Band(f"b{i:05}", Decimal(i), Decimal(i + 1), Decimal("0.5"))
        for i in range(count)
        if i % 3 != 1
    ]
    amounts = spark.range(-150, 100 * count + 250, 37).select(F.col("id").alias("face_cents"))
    joined = spark.createDataFrame(
        [(b.name, int(b.low * 100), int(b.high * 100)) for b in table],
        "band string, low bigint, high bigint",
    )
    expected = (
        amounts.join(joined, (F.col("face_cents") >= F.col("low")) & (F.col("face_cents") < F.col("high")), "left")
        .groupBy("band")
        .count()
    )
    assert rows_of(bands.band_rates(amounts, table), "band", "n_receivables") == rows_of(expected)


LINES = "receivable bigint, assignor bigint, returned boolean, line_cents bigint"


def test_return_rate(spark, rows_of):
    rows = [(1, "O", None, 0), (1, "O", None, 0), (2, "O", None, 0), (3, "O", None, 0)]
    sold = spark.createDataFrame(
        [(0, 1, True, 100), (0, 1, False, 100), (1, 1, False, 200), (2, 1, None, 70), (3, 1, True, 0)],
        LINES,
    )
    debtors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "debtor bigint, segment string")
    assert rows_of(lines.return_rate_by_segment(sold, book(spark, rows), debtors)) == [
        ("a", Decimal("4.00"), Decimal("1.00"), 0.25),
        ("b", Decimal("0.70"), Decimal("0.00"), 0.0),
        ("c", Decimal("0.00"), Decimal("0.00"), None),
    ]


def test_no_line_is_lost_from_the_return_rate(spark, rows_of):
    """Line without an order, order without a customer: the null segment."""
    sold = spark.createDataFrame([(0, 1, True, 100), (1, 1, False, 200), (9, 1, True, 40)], LINES)
    debtors = spark.createDataFrame([(1, "a")], "debtor bigint, segment string")
    rows = [(1, "O", None, 0), (7, "O", None, 0)]
    assert rows_of(lines.return_rate_by_segment(sold, book(spark, rows), debtors)) == [
        (None, Decimal("2.40"), Decimal("0.40"), 0.16666667),
        ("a", Decimal("1.00"), Decimal("1.00"), 1.0),
    ]


def test_debtors_without_a_customer_row_stay_in_the_book(spark, rows_of):
    debtors = spark.createDataFrame([(1, "a")], "debtor bigint, segment string")
    rows = [(1, "O", None, 100), (2, "O", None, 300), (None, "O", None, 300)]
    assert rows_of(concentration.debtor_concentration(book(spark, rows), debtors)) == [
        (None, 2, Decimal("6.00"), 0.5),
        ("a", 1, Decimal("1.00"), 1.0),
    ]


def test_a_position_without_a_status_is_open(spark):
    rows = [(1, None, date(2020, 1, 1), 1), (1, "F", date(2020, 1, 1), 1), (1, "O", date(2020, 1, 1), 1)]
    assert [row[:2] for row in ageing.age_buckets(book(spark, rows), date(2020, 1, 2)).collect()] == [
        ("0-30", 2)
    ]


def test_header_line_check(spark, rows_of):
    rows = [(1, "O", None, amount) for amount in (10, 20, 30, 40, 50)]
    sold = spark.createDataFrame(
        [(0, 1, False, 4), (0, 1, False, 5), (1, 1, False, 21), (2, 1, False, 30), (99, 1, False, 1)],
        LINES,
    )
    assert rows_of(lines.header_line_check(book(spark, rows), sold)) == [
        ("equal", 1, Decimal("0.30"), Decimal("0.30")),
        ("no lines", 2, Decimal("0.90"), Decimal("0.00")),
        ("no order", 1, Decimal("0.00"), Decimal("0.01")),
        ("over", 1, Decimal("0.10"), Decimal("0.09")),
        ("under", 1, Decimal("0.20"), Decimal("0.21")),
    ]


EVENTS = "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string"


def test_state_as_of(spark, rows_of):
    events = spark.createDataFrame(
        [
            (1, datetime(2023, 5, 1, 12), 1, "old"),
            (1, datetime(2024, 1, 8), 2, "at midnight"),
            (1, datetime(2024, 1, 8, 0, 0, 0, 1), 3, "just after"),
            (1, datetime(2024, 1, 15), 4, "tie a"),
            (1, datetime(2024, 1, 15), 5, "tie b"),
            (2, datetime(2024, 1, 9), 6, "first"),
            (3, datetime(2024, 3, 1), 7, "too late"),
            (4, None, 8, "no time"),
        ],
        EVENTS,
    )
    days = [date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 15)]
    found = asof.state_as_of(events, "user_id", "ts", "event_id", ["event_type"], days[0], 7, 3)
    states = {1: ["old", "at midnight", "tie b"], 2: [None, None, "first"], 3: [None] * 3, 4: [None] * 3}
    assert rows_of(found) == [
        (user, day, state) for user in states for day, state in zip(days, states[user])
    ]


def test_sessions_split_only_beyond_the_gap(spark, rows_of):
    gap = timedelta(hours=6)
    start = datetime(2024, 1, 1, 5, 59)
    tick = timedelta(microseconds=1)
    events = spark.createDataFrame(
        [
            (1, start, 1, "x"),
            (1, start + gap, 2, "x"),
            (1, start + 2 * gap + tick, 3, "x"),
            (1, None, 4, "x"),
            (None, start, 5, "x"),
            (None, start + tick, 6, "x"),
        ],
        EVENTS,
    )
    assert rows_of(sessions.sessions(events, "user_id", "ts", gap)) == [
        (None, start, 2),
        (1, start, 2),
        (1, start + 2 * gap + tick, 1),
    ]


def test_empty_tables_give_empty_results(spark):
    none = book(spark, [])
    sold = spark.createDataFrame([], LINES)
    debtors = spark.createDataFrame([], "debtor bigint, segment string")
    events = spark.createDataFrame([], EVENTS)
    for result in (
        origination.by_month(none),
        origination.cohorts(none),
        ageing.age_buckets(none, date(2020, 1, 1)),
        concentration.largest_debtors(none),
        concentration.debtor_concentration(none, debtors),
        bands.band_rates(none, BANDS),
        lines.return_rate_by_segment(sold, none, debtors),
        lines.header_line_check(none, sold),
        asof.state_as_of(events, "user_id", "ts", "event_id", ["event_type"], date(2024, 1, 1), 7, 3),
        sessions.sessions(events, "user_id", "ts", timedelta(hours=1)),
    ):
        assert result.collect() == []
