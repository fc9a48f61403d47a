"""The queries by name, each with its twin in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import checks, features, hypotheses, landing, pages, panels, relations, replication, scans, signals, studies, tracks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["breakout_position"](spark, sf_dir)
