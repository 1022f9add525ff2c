"""Classify click-stream events as they arrive (row-wise, stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions import expr as X
from basketlens.schemas import EVENTS


def classify(events: DataFrame) -> DataFrame:
    """P1 + P3 + P4 on any events frame, batch or streaming."""
    return events.select(
        "distinct_id", F.lower("email").alias("email"), "time", "name",
        X.page_class("name").alias("event"),
        X.path_name("name").alias("path_name"),
        X.platform("os").alias("platform"),
        X.day_of("time").alias("day"))


def read_event_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files_per_trigger: int = 100) -> DataFrame:
    """A file stream of model events with the fixed event schema."""
    return (spark.readStream.schema(EVENTS).format(fmt)
                 .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def start_classifier(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "parquet",
                     tracked_only: bool = True, trigger_once: bool = False):
    """Stream ``source`` -> classified parquet at ``sink`` partitioned by day.
    ``checkpoint`` must be a shared, durable path (the stream's state)."""
    ev = read_event_stream(spark, source, fmt)
    if tracked_only:
        ev = ev.where(F.col("name").isin(*X.TRACKED_EVENT_NAMES))
    writer = (classify(ev).writeStream.format("parquet").option("path", sink)
                          .option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
