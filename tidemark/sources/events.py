"""Sink of one run: a call row with its configuration and the event rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.mentions import join_links


def call_row(
    spark: SparkSession, call_id: int, stock_id: int, call_time: dt.datetime, interval: int, top_n: int, config: Mapping
) -> DataFrame:
    """The run record."""
    schema = "call_id long, stock_id long, call_time timestamp, interval int, top_n int, config string"
    row = (call_id, stock_id, call_time, interval, top_n, json.dumps(dict(config), sort_keys=True))
    return spark.createDataFrame([row], schema)


def event_rows(info: DataFrame, call_id: int, stock_id: int, interval: int) -> DataFrame:
    """Event records from cluster rows; lists also as comma text, names only."""
    names = {
        f"top_{short}": join_links(F.transform(F.col(f"top_{kind}"), lambda e: e["name"]))
        for short, kind in (("themes", "themes"), ("persons", "persons"), ("orgs", "organizations"), ("locs", "locations"))
    }
    return info.select(
        F.concat_ws("-", F.lit(call_id), F.col("cluster")).alias("event_id"),
        F.lit(stock_id).cast("long").alias("stock_id"),
        F.lit(call_id).cast("long").alias("call_id"),
        F.col("cluster").alias("cluster_id"),
        join_links("top_articles").alias("top_articles"),
        *[c.alias(n) for n, c in names.items()],
        F.array("size_importance", "cohesiveness", "time_variance").alias("cluster_health"),
        "median_date",
        F.lit(interval).alias("event_window"),
        "mean_embedding",
        F.lit(False).alias("irrelevant"),
    )


def write_events(info: DataFrame, call: DataFrame, path: str) -> None:
    """Add the call and its events; a call that is written again replaces its own rows and no others."""
    head = call.first()
    rows = event_rows(info, head["call_id"], head["stock_id"], head["interval"])
    for df, name in ((call, "calls"), (rows, "events")):
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("call_id").parquet(f"{path}/{name}")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """All run records."""
    return spark.read.parquet(f"{path}/calls").withColumn("call_id", F.col("call_id").cast("long"))


def read_events(spark: SparkSession, path: str, call_id: int | None = None, schema: StructType | None = None) -> DataFrame:
    """Event records; of one call, only its folder is listed. ``schema`` is for stores that may hold no event yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/events")
    if call_id is not None:
        rows = rows.where(F.col("call_id") == call_id)
    return rows.withColumn("call_id", F.col("call_id").cast("long"))
