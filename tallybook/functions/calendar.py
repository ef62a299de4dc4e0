"""Calendar expressions that do not depend on the session time zone for ``timestamp_ntz`` input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def month_of(moment: str | Column) -> Column:
    """First day of the month, as a date (``date_trunc`` would give a zoned timestamp)."""
    return F.trunc(F.to_date(_col(moment)), "month")


def month_number(month: str | Column) -> Column:
    """Months since year 0: differences are whole calendar months."""
    month = _col(month)
    return F.year(month) * 12 + F.month(month)


def whole_days(earlier: str | Column, later: str | Column) -> Column:
    """Days from one date or timestamp to another, ignoring the time of day."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier)))


def epoch_seconds(moment: str | Column) -> Column:
    """Seconds from 1970 to a ``timestamp_ntz``, read off its own calendar fields."""
    moment = _col(moment)
    days = F.unix_date(F.to_date(moment)).cast("bigint")
    clock = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return days * 86400 + clock


def epoch_micros(moment: str | Column) -> Column:
    """Microseconds from 1970 to a ``timestamp_ntz``."""
    moment = _col(moment)
    fraction = F.date_part(F.lit("SECOND"), moment) - F.second(moment)
    return epoch_seconds(moment) * 1_000_000 + (fraction * 1_000_000).cast("bigint")
