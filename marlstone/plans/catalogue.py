"""All core queries and the SQL that checks them."""

from __future__ import annotations

from marlstone.plans import core_queries, quality, record_queries

QUERIES = {**core_queries.QUERIES, **quality.QUERIES, **record_queries.QUERIES}
ORACLES: dict[str, str] = {**core_queries.ORACLES, **record_queries.ORACLES}
