"""File sources and sinks.

CSV is read with a header, RFC quoting and *all columns as text*; types are
then applied by the declared maps (P19), never inferred. Report rows saved
as JSON keep only the last dotted part of each column name (S8). A
spreadsheet tab is exchanged as CSV (S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import expr as X
from basketlens.schemas import EVENTS


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV, every column a string (quoted fields, doubled quotes)."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"') \
        .option("multiLine", False).option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header (no index column)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_user_list(spark: SparkSession, path: str) -> DataFrame:
    """A user list file (column ``email``)."""
    return read_csv_text(spark, path).select("email")


def read_report_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     one_array: bool = False) -> DataFrame:
    """Saved report rows, columns renamed to the last dotted part; a
    collision of short names is an error. Rows are JSON lines (or an array on
    each line); with ``one_array`` each file is one JSON array over any number
    of lines, as the report server sends it, read by one task a file."""
    reader = spark.read.option("multiLine", one_array)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    short = [c.split(".")[-1] for c in df.columns]
    dup = {s for s in short if short.count(s) > 1}
    if dup:
        raise ValueError(f"report columns collide after shortening: {sorted(dup)}")
    return df.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(df.columns, short)])


def read_sheet_export(spark: SparkSession, path: str) -> DataFrame:
    """S9 (re-aimed): a spreadsheet tab exported as CSV."""
    return read_csv_text(spark, path)


def write_sheet_export(df: DataFrame, path: str) -> None:
    """S9 (re-aimed): write a frame for upload to a spreadsheet tab. The plan
    runs at full width; only its rows meet in one file, by a shuffle."""
    write_csv(df.repartition(1), path)


def gathered_by_day(events: DataFrame) -> DataFrame:
    """The events with their ``event_date``, a day's rows together: one shuffle
    whose large partitions are split and small ones joined by size. No pass over
    the events samples bounds before it."""
    return events.withColumn("event_date", F.to_date("time")).hint("rebalance", "event_date")


def write_events_by_day(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lay the click-stream out by day so date-bounded queries prune partitions."""
    gathered_by_day(events).write.mode(mode).partitionBy("event_date").parquet(path)


def events_by_day(spark: SparkSession, path: str) -> DataFrame:
    """The layout of ``write_events_by_day`` with its partition column
    ``event_date``, by which ``events_in`` prunes days."""
    return spark.read.schema(T.StructType([*EVENTS.fields, T.StructField("event_date", T.DateType())])).parquet(path)


def read_events_by_day(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Events with start <= time <= end from the layout of ``write_events_by_day``;
    other days are not read. Events without a time are in no interval."""
    return X.events_in(events_by_day(spark, path), start, end)
