"""All named queries of the core with their SQL: those of `queries`, and those of the stores, which register beside them."""

from semblance.plans import store_queries
from semblance.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "store_queries"]
