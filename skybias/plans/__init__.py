"""Whole jobs, and the registered queries with their checks."""

from skybias.plans import queries_explore, queries_models, queries_scores, queries_series, queries_sources  # noqa: F401
from skybias.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
