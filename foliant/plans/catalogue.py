"""Queries over the driver's tables, by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import evidence_queries, feature_queries, gate_queries, label_queries, metric_queries, model_queries, other_queries, routing_queries, selector_queries, source_queries, spatial_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
