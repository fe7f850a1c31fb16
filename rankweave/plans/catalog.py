"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analysis_queries, board_queries, event_queries, history_queries, ledger_queries, model_queries, player_queries, region_queries, replay_queries, series_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series with its score, format, state and winner."""
    return QUERIES["d2_series_resolution"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
