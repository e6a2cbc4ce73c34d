"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
