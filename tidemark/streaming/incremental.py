"""Process events as their files arrive."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tidemark.operators.joins import unprocessed

# Folders of the id index.
BUCKETS = 64


def read_arrivals(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Stream of event rows from a growing folder; ``pattern`` picks files by name."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def incremental_events(
    arrivals: DataFrame, process: Callable[[DataFrame], DataFrame], processed_path: str, checkpoint: str
) -> DataStreamWriter:
    """Writer that processes each event once.

    Only events that are unflagged and not processed yet go through ``process``. Within a run the ids are keyed state of
    the stream, so a repeat is dropped without reading what was written (keep large states in Spark's RocksDB store).
    Ids of other runs are in an index beside the table, in ``BUCKETS`` folders by hash; a batch reads the id column of
    the folders its own ids fall in. A batch writes its own folders in overwrite mode, named by the run (which keeps its
    id as long as its checkpoint) and the batch, so a repeated batch gives the same table.
    """
    fresh = arrivals.where(~F.coalesce("irrelevant", F.lit(False))).dropDuplicates(["event_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = _run_id(spark, checkpoint)
        own, arrived = f"{run}-{batch_id}", f"{processed_path}/_arrived/{run}-{batch_id}"
        # The stream's state is asked once; all later steps read what it let through.
        batch.select("*", _bucket()).write.mode("overwrite").parquet(arrived)
        todo = spark.read.parquet(arrived)
        done = _ids_of_other_runs(spark, processed_path, run, todo)
        if done is not None:
            todo = unprocessed(todo, done)
        process(todo.drop("_bucket")).write.mode("overwrite").parquet(f"{processed_path}/batch={own}")
        todo.select("event_id", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{processed_path}/_keys/run={run}/batch={batch_id}")
        _delete(spark, arrived)

    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a run's checkpoint folder."""
    metadata = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(metadata)["id"]


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _ids_of_other_runs(spark: SparkSession, path: str, run: str, todo: DataFrame) -> DataFrame | None:
    """Ids processed by other runs in the buckets of ``todo``, or None if there are none."""
    keys = _read_or_none(spark, f"{path}/_keys")
    if keys is None:
        rows = _read_or_none(spark, path)
        if rows is None:
            return None
        # A table from before the index: its ids are entered once.
        before = rows.where(~F.col("batch").startswith(f"{run}-")).select("event_id", _bucket())
        before.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_keys/run=before/batch=0")
        keys = _read_or_none(spark, f"{path}/_keys")
        if keys is None:
            return None
    touched = [r["_bucket"] for r in todo.select("_bucket").distinct().collect()]
    return keys.where((F.col("run") != run) & F.col("_bucket").isin(touched)).select("event_id")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int").alias("_bucket")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
