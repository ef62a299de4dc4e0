"""The queries by name: operators bound to the tables and to report parameters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook import sources
from tallybook.operators import (
    ageing,
    asof,
    bands,
    concentration,
    lines,
    origination,
    sessions,
    transitions,
)
from tallybook.streaming import daily

SESSION_GAP = timedelta(hours=6)
# Bands and rates show the lookup at work; they stand for no rule or tariff.
RATE_BANDS = [
    bands.Band("small", Decimal("0"), Decimal("100000"), Decimal("0.005")),
    bands.Band("medium", Decimal("100000"), Decimal("300000"), Decimal("0.0125")),
    bands.Band("large", Decimal("300000"), None, Decimal("0.02")),
]


def _receivables(spark: SparkSession, root: str) -> DataFrame:
    return sources.receivables(sources.read_table(spark, root, "orders"))


def _order_lines(spark: SparkSession, root: str) -> DataFrame:
    return sources.order_lines(sources.read_table(spark, root, "lineitem"))


def _debtors(spark: SparkSession, root: str) -> DataFrame:
    return sources.debtors(sources.read_table(spark, root, "customer"))


def _user_events(spark: SparkSession, root: str) -> DataFrame:
    return sources.user_events(sources.read_table(spark, root, "events"))


def monthly_origination(spark: SparkSession, root: str) -> DataFrame:
    return origination.by_month(_receivables(spark, root))


def age_buckets(spark: SparkSession, root: str, as_of: date | None = None) -> DataFrame:
    """By default as of the latest origination in the book."""
    book = _receivables(spark, root)
    latest = book.agg(F.to_date(F.max("originated"))).scalar()
    return ageing.age_buckets(book, as_of or latest)


def largest_debtors(spark: SparkSession, root: str) -> DataFrame:
    return concentration.largest_debtors(_receivables(spark, root))


def debtor_concentration(spark: SparkSession, root: str) -> DataFrame:
    return concentration.debtor_concentration(_receivables(spark, root), _debtors(spark, root))


def assignor_rollup(spark: SparkSession, root: str) -> DataFrame:
    return concentration.assignor_rollup(
        _order_lines(spark, root),
        sources.assignors(sources.read_table(spark, root, "supplier")),
        sources.nations(
            sources.read_table(spark, root, "nation"), sources.read_table(spark, root, "region")
        ),
    )


def origination_cohorts(spark: SparkSession, root: str) -> DataFrame:
    return origination.cohorts(_receivables(spark, root))


def trailing_origination(spark: SparkSession, root: str) -> DataFrame:
    return origination.trailing(monthly_origination(spark, root))


def event_transitions(spark: SparkSession, root: str) -> DataFrame:
    return transitions.transition_matrix(
        transitions.consecutive_pairs(
            _user_events(spark, root), "user_id", "ts", "event_id", "event_type"
        )
    )


def band_rates(spark: SparkSession, root: str) -> DataFrame:
    return bands.band_rates(_receivables(spark, root), RATE_BANDS)


def return_rate_by_segment(spark: SparkSession, root: str) -> DataFrame:
    return lines.return_rate_by_segment(
        _order_lines(spark, root), _receivables(spark, root), _debtors(spark, root)
    )


def header_line_check(spark: SparkSession, root: str) -> DataFrame:
    return lines.header_line_check(_receivables(spark, root), _order_lines(spark, root))


def weekly_state(
    spark: SparkSession, root: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Weekly from ``start`` to ``end``, by default the days of the first and last event.

    The default reads the event times once, when the query is built.
    """
    events = _user_events(spark, root)
    if start is None or end is None:
        span = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
        start, end = start or span[0], end or span[1]
    weeks = (end - start).days // 7 + 1 if start and end else 0
    return asof.state_as_of(
        events, "user_id", "ts", "event_id", ["event_type"], start or date.min, 7, weeks
    )


def activity_sessions(spark: SparkSession, root: str) -> DataFrame:
    return sessions.sessions(_user_events(spark, root), "user_id", "ts", SESSION_GAP)


def streamed_daily_events(spark: SparkSession, root: str) -> DataFrame:
    return daily.streamed_daily_counts(spark, root)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        monthly_origination,
        age_buckets,
        largest_debtors,
        debtor_concentration,
        assignor_rollup,
        origination_cohorts,
        trailing_origination,
        event_transitions,
        band_rates,
        return_rate_by_segment,
        header_line_check,
        weekly_state,
        activity_sessions,
        streamed_daily_events,
    )
}
