"""Imports every query module, so that the registry is complete."""

from . import derived_sql  # noqa: F401
from . import market_queries, quality_queries, feature_queries, signal_queries, research_queries, learning_queries, operation_queries, governance_queries, source_queries, table_queries  # noqa: F401, I001
from .registry import ORACLES, QUERIES  # noqa: F401
