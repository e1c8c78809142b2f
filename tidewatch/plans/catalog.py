"""Imports every module that registers queries."""

from tidewatch.plans import detect_queries, inject_queries, model_queries, panel_queries, source_queries  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
