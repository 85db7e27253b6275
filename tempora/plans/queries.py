"""All queries of the library and their oracle SQL."""

from __future__ import annotations

from . import chat_queries, data_queries, reward_queries, timeline_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
