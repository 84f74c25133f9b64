"""All queries over the catalog's own operators, and their SQL."""

from __future__ import annotations

from framewell.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "dedup_groups"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
