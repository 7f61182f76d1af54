"""The table of named queries over the reference tables, and their SQL."""

from brinewood.plans import list_queries, page_queries, record_queries, report_queries, search_queries  # noqa: F401  (imports register queries)
from brinewood.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
