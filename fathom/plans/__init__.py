"""Registered queries over the test tables, each with the SQL it must agree with."""

from . import aggregates, asked, bundled, filed, filters, indexed, ordered, relations, search, upkeep, worded
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "asked", "bundled", "filed", "filters", "indexed", "ordered", "relations", "search", "upkeep", "worded"]
