"""All queries of the code-graph engine, and their SQL."""

from __future__ import annotations

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
