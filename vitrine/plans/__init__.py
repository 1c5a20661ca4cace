"""The dashboard queries (Q01-Q40), the ingest merges and their registry."""

from .registry import JOBS, QUERIES, SALES_AS_OF, SALES_PERIOD, SEARCH_AS_OF, SEARCH_PERIOD, query_callable, run

__all__ = ["JOBS", "QUERIES", "SALES_AS_OF", "SALES_PERIOD", "SEARCH_AS_OF", "SEARCH_PERIOD",
           "query_callable", "run"]
