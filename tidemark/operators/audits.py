"""Constraint audits: rows that break a uniqueness or count rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: most areas of interest per alert stock.
MAX_AREAS = 5


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_positions(positions: DataFrame) -> DataFrame:
    return duplicates(positions, ["portfolio_id", "stock_id"])


def duplicate_alert_stocks(alert_stocks: DataFrame) -> DataFrame:
    return duplicates(alert_stocks, ["alert_id", "stock_id"])


def duplicate_areas(areas: DataFrame) -> DataFrame:
    return duplicates(areas, ["alert_stock_id", "description"])


def too_many_areas(areas: DataFrame, limit: int = MAX_AREAS) -> DataFrame:
    counted = areas.groupBy("alert_stock_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit)
