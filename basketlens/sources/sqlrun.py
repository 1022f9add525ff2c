"""Run SQL text (or a .sql file) with named parameters, lower-case the
result's column names, and optionally keep a snapshot of the result.

Parameters use Spark's named markers (``:start``); the analysed SQL used
``%(start)s``, which ``to_named_markers`` rewrites. Values are bound by
Spark (``spark.sql(text, args=...)``), never pasted into the text.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.snapshots import DIR_CONF, Snapshots, UnversionedSource
from basketlens.sources.snapshots import source_version as version_of

_PYFORMAT = re.compile(r"%\((\w+)\)s")


def to_named_markers(sql: str) -> str:
    """``%(name)s`` -> ``:name``."""
    return _PYFORMAT.sub(lambda m: ":" + m.group(1), sql)


def resolve_sql(sql: str, sql_dir: str | None = None) -> str:
    """The argument may be SQL text or a file name (as given, or under sql_dir)."""
    for path in [sql] + ([os.path.join(sql_dir, sql)] if sql_dir else []):
        if len(path) < 4096 and os.path.isfile(path):
            with open(path) as f:
                return f.read()
    return sql


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def sql_to_df(spark: SparkSession, sql: str, sql_dir: str | None = None, use_cache: bool | None = None,
              cache_root: str | None = None, source_version: str | None = None, **params) -> DataFrame:
    """Run parameterised SQL against registered views. A list value
    is bound as an array (``array_contains(:users, email)``).

    The result is kept as a snapshot (``use_cache``; default: where
    ``cache_root`` or ``spark.basketlens.snapshot.dir`` names a folder). Its
    key holds the SQL text, the parameters and the version of the files the
    plan reads, or ``source_version`` where the caller gives one; a plan over
    rows without files and without ``source_version`` runs anew each time."""
    text = to_named_markers(resolve_sql(sql, sql_dir))
    df = lower_columns(spark.sql(text, args={k: _bound(v) for k, v in params.items()} or None))
    root = cache_root or spark.conf.get(DIR_CONF, None)
    if use_cache and not root:
        raise ValueError(f"use_cache needs cache_root or {DIR_CONF} (a shared path)")
    if not root or use_cache is False:
        return df
    if source_version is None:
        try:
            source_version = version_of(spark, df)
        except UnversionedSource:
            return df
    return Snapshots(spark, root).get("sql", lambda: df, [], {"sql": text, **params}, source_version, code="")


def _bound(value):
    return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else value
