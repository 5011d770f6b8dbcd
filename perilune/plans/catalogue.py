"""All queries and their SQL."""

from __future__ import annotations

from perilune.plans import attitude_queries, command_queries, format_queries, frame_queries, more_queries, nav_queries, pipeline_queries, series_queries, source_queries, stream_queries  # noqa: F401  each registers its queries
from perilune.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
