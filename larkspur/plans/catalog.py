"""Imports every query module so that the registry is complete."""

from . import (  # noqa: F401
    analytics_queries, eval_queries, join_queries, mart_queries, metric_queries, monitor_queries, search_queries, source_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
