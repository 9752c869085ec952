"""All queries of the library and their SQL."""

from corvane.plans import event_queries, golden_queries, report_queries, run_queries, text_queries, vote_queries  # noqa: F401
from corvane.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
