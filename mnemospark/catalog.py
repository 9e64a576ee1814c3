"""Imports every module that registers queries."""

from __future__ import annotations

from mnemospark.queries import analytics, forecasts, graphs, imports, memory, models, reasoning, recommendations, search, streams, texts, upkeep  # noqa: F401
from mnemospark.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
