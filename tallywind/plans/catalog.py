"""Imports every module that registers queries."""

from . import analytics_queries, enrichment_queries, io_queries, run_queries, sql_queries  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
