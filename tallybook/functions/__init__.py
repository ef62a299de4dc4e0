"""Column expressions shared by the operators."""

from tallybook.functions.calendar import (
    epoch_micros,
    epoch_seconds,
    month_number,
    month_of,
    whole_days,
)
from tallybook.functions.money import cents, discounted_cents, ratio, total, units

__all__ = [
    "cents",
    "discounted_cents",
    "epoch_micros",
    "epoch_seconds",
    "month_number",
    "month_of",
    "ratio",
    "total",
    "units",
    "whole_days",
]
