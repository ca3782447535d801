"""Imports every query module, so that the registry is complete."""

from orrery.plans import entity_queries, model_queries, profile_queries, scalar_queries, source_queries, stat_queries, text_queries  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
