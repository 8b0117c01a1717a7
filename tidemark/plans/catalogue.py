"""All registered queries of the measurement engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anomaly_queries, calendar_queries, flagship_queries, game_queries, text_queries, validation_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (calendar_queries, text_queries, anomaly_queries, flagship_queries, validation_queries, game_queries):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
