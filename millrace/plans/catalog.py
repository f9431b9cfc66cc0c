"""All queries by name, and those of them that have an equivalent in SQL."""

from __future__ import annotations

from millrace.plans import registry, reports

QUERIES = registry.QUERIES | reports.QUERIES
ORACLES = registry.ORACLES | reports.ORACLES
