"""The registered queries and the SQL they are checked against."""

from tallybook.plans.catalog import QUERIES
from tallybook.plans.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
