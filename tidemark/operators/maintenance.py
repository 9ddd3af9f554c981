"""Table maintenance as new DataFrames: append, delete, upsert, cascade, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import first_per_key


def add_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new)


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def upsert_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace rows by key and add the ones with new keys."""
    return delete_rows(table, changes, key).unionByName(changes)


def remove_stock(
    removals: DataFrame, bridge: DataFrame, alert_stocks: DataFrame, positions: DataFrame
) -> dict[str, DataFrame]:
    """What stays after users remove stocks: portfolio members, their alert stocks
    and their positions. Every table carries ``user_id`` and ``stock_id``."""
    gone = removals.select("user_id", "stock_id")
    tables = {"bridge": bridge, "alert_stocks": alert_stocks, "positions": positions}
    return {name: t.join(gone, ["user_id", "stock_id"], "left_anti") for name, t in tables.items()}


def get_or_create(wanted: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column]) -> DataFrame:
    """Existing rows plus a default row for every wanted key that has none."""
    missing = wanted.select(*keys).distinct().join(table.select(*keys), list(keys), "left_anti")
    created = missing.select(*keys, *[c.alias(name) for name, c in defaults.items()])
    return table.unionByName(created)


def flag_events(events: DataFrame, hits: DataFrame, flag: str = "irrelevant") -> DataFrame:
    """Set the flag on every event listed in ``hits``."""
    marks = hits.select("event_id").distinct().withColumn("_hit", F.lit(True))
    flagged = events.join(marks, "event_id", "left").withColumn(
        flag, F.coalesce("_hit", F.coalesce(flag, F.lit(False)))
    )
    return flagged.select(*events.columns)


def set_interest(positions: DataFrame, changes: DataFrame) -> DataFrame:
    """New area of interest (and its rewritten form) for (portfolio, stock) pairs."""
    keys = ["portfolio_id", "stock_id"]
    texts = ["area_of_interest", "processed_area_of_interest"]
    new = changes.select(*keys, *[F.col(t).alias(f"_{t}") for t in texts])
    joined = positions.join(new, keys, "left")
    updated = joined.withColumns({t: F.coalesce(f"_{t}", t) for t in texts})
    return updated.select(*positions.columns)


def add_positions(positions: DataFrame, bridge: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert positions whose (portfolio, stock) pair is new.

    Returns positions, bridge rows and the rejected rows (pair exists already or
    a second row of the same pair in the batch).
    """
    keys = ["portfolio_id", "stock_id"]
    accepted = first_per_key(new.join(positions.select(*keys), keys, "left_anti"), keys, [order])
    rejected = new.join(accepted.select(order), order, "left_anti")
    members = bridge.unionByName(
        accepted.select(*keys).join(bridge.select(*keys), keys, "left_anti")
    )
    return positions.unionByName(accepted.drop(order)), members, rejected
