"""All queries outside the llm subpackage, and the SQL that checks them."""

from __future__ import annotations

from lectern.plans import annotation_queries, core_queries, relational_queries, service_queries

FLAGSHIP = "entity_histogram"
_MODULES = (core_queries, relational_queries, annotation_queries, service_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
