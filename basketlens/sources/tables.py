"""The model tables as one bundle of DataFrames."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.schemas import MODEL_SCHEMAS


@dataclass
class ShopTables:
    orders: DataFrame
    line_items: DataFrame
    variants: DataFrame
    products: DataFrame
    option_values_variants: DataFrame
    option_values: DataFrame
    product_map: DataFrame
    events: DataFrame
    # Customer export and user lists feed the customer table.
    customer_export: DataFrame | None = None
    user_lists: dict = field(default_factory=dict)

    def register(self, prefix: str = "") -> None:
        """Expose every table as a temp view (for ``sql_to_df``)."""
        for name in MODEL_SCHEMAS:
            getattr(self, name).createOrReplaceTempView(prefix + name)
        if self.customer_export is not None:
            self.customer_export.createOrReplaceTempView(prefix + "customer_export")


#: Tables written in buckets of the order id: the joins and roll-ups of an
#: order's lines then need no shuffle.
BUCKETED = {"orders": "id", "line_items": "order_id"}
LAYOUT = "_layout"


def _table_name(root: str, name: str) -> str:
    return f"basketlens_{hashlib.sha256(root.encode()).hexdigest()[:12]}_{name}"


def write_model(tables: ShopTables, root: str, buckets: int = 200) -> None:
    """The model below ``root``, orders and line items in ``buckets``
    buckets of the order id, sorted by it. Choose ``buckets`` so that a bucket
    of line items is some hundred MB."""
    root = root.rstrip("/")
    for name in MODEL_SCHEMAS:
        df, key = getattr(tables, name), BUCKETED.get(name)
        if key is None:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            continue
        table = _table_name(root, name)
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        # One task per bucket, so a bucket is one file (a hot order stays whole in it).
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
           .option("path", f"{root}/{name}").saveAsTable(table))
    spark = tables.orders.sparkSession
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{root}/{LAYOUT}")


def read_model(spark: SparkSession, root: str, fmt: str = "parquet", bucketed: bool = False) -> ShopTables:
    """Read the model tables from ``root/<table>`` with fixed schemas (no
    inference). ``bucketed``: as ``write_model`` laid them out; orders and line
    items are then declared to this session with their buckets."""
    root = root.rstrip("/")
    frames = {}
    for name, schema in MODEL_SCHEMAS.items():
        if not (bucketed and name in BUCKETED):
            frames[name] = spark.read.schema(schema).format(fmt).load(f"{root}/{name}")
            continue
        buckets, table, key = spark.read.parquet(f"{root}/{LAYOUT}").first().buckets, _table_name(root, name), BUCKETED[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        path = f"{root}/{name}".replace("'", "\\'")
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
        frames[name] = spark.table(table)
    return ShopTables(**frames)
