"""Loads every module that registers queries."""

from viewlog.plans import (  # noqa: F401
    queries_generate,
    queries_operators,
    queries_page_views,
    queries_series,
    queries_sources,
)
from viewlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
