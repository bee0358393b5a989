"""Queries: operators bound to tables, each with the SQL it is checked against."""

from ..registry import QUERIES, SQL
from . import compositions, content, details, fields, generated, listings, lookups, nests, rulebook, statistics, streams, updates  # noqa: F401  (they register their queries)

__all__ = ["QUERIES", "SQL"]
