"""All named queries over the driver tables, and their SQL."""

from __future__ import annotations

from tidemark.plans import extra_queries, join_queries, model_queries, panel_queries, portfolio_queries, rate_queries, resample_queries, risk_queries, scoring_queries, stream_queries
from tidemark.plans.catalog import ORACLES, QUERIES

MODULES = (panel_queries, risk_queries, join_queries, scoring_queries, rate_queries, resample_queries, model_queries, stream_queries, portfolio_queries, extra_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
