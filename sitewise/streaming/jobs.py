"""Job states: the latest event of each job, over a table or kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def latest_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event per job by time, then event id; a partial maximum, so no job's events meet in one place."""
    last = events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type", "value", "props")).alias("m"))
    return last.select(key, "m.*")


def latest_states_stream(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """As ``latest_states``, of Parquet files as they arrive; write it with output mode ``update`` or ``complete``."""
    return latest_states(spark.readStream.schema(SCHEMA).parquet(path), key)


def windowed_counts_stream(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per type and window of time, later ones than the watermark left out."""
    events = spark.readStream.schema(SCHEMA).parquet(path).withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
