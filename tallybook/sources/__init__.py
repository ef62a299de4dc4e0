"""Input tables, the receivables view of them, and shared folders."""

from tallybook.sources.portfolio import (
    assignors,
    debtors,
    nations,
    order_lines,
    receivables,
    user_events,
)
from tallybook.sources.tables import SCHEMAS, read_table
from tallybook.sources.workspace import run_folder

__all__ = [
    "SCHEMAS",
    "assignors",
    "debtors",
    "nations",
    "order_lines",
    "read_table",
    "receivables",
    "run_folder",
    "user_events",
]
