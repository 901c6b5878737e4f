"""All queries over the given tables."""

from splitboard.plans import catalog_queries, entry_queries, load_queries, result_queries, sheet_queries
from splitboard.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "entry_queries", "load_queries", "result_queries", "sheet_queries"]
