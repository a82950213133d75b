"""The registered queries."""

from skyledger.plans import catalog_queries, characterize_queries, delivery_queries, explore_queries, ingest_queries, more_queries
from skyledger.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog_queries", "characterize_queries", "delivery_queries", "explore_queries", "ingest_queries", "more_queries"]
