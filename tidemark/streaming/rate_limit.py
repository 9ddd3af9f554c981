"""Users above their request rate, as batch and as stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (window, most requests) of the news view and of the settings view.
VIEW_LIMITS = (("1 minute", 10), ("1 day", 1000))
SETTINGS_LIMITS = (("1 minute", 5), ("1 day", 100))


def over_limit(log: DataFrame, window: str, limit: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, window start, requests) above the limit; works on batch and stream."""
    counted = log.groupBy(F.window(F.col(ts).cast("timestamp"), window), user).agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > limit).select(
        user, F.col("window.start").alias("window_start"), F.lit(window).alias("per"), "requests"
    )


def rate_limit_audit(log: DataFrame, limits: Sequence[tuple[str, int]] = VIEW_LIMITS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """All violations of a set of limits over a finished log."""
    parts = [over_limit(log, window, limit, user, ts) for window, limit in limits]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def rate_limit_stream(log: DataFrame, window: str, limit: int, lateness: str = "10 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same over a stream; state of a window is dropped after ``lateness``."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return over_limit(timed, window, limit, user, ts)
