"""All registered queries and their SQL twins."""

from __future__ import annotations

from tallyloom.plans import counts, gates, joins, observations, orders, sources, texts, views, windows  # noqa: F401  they register their queries
from tallyloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "edition_summary"
