"""Every query of the content-safety part with the SQL that states the same result."""

from __future__ import annotations

from palisade.plans import action_queries, record_queries, screening_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (screening_queries, action_queries, record_queries):
    QUERIES |= _m.REGISTRY.queries
    ORACLE |= _m.REGISTRY.oracle
