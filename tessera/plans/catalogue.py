"""All registered queries."""

from tessera.plans import graph_queries, pipeline_queries, relational_queries, search_queries, service_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
