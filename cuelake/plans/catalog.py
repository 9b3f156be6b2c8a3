"""All queries over the driver tables, and their DuckDB twins."""

from __future__ import annotations

from cuelake.plans import interval_queries, suite_queries  # noqa: F401  the second one adds its queries to the first one's

QUERIES = {**interval_queries.QUERIES}
ORACLES = {**interval_queries.ORACLES}
