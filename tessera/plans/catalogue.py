"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import elements, lexicometry, measures, relational, reports  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
