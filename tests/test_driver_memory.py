"""What the driver holds: broadcast tables stay small, whatever their files' size."""
from pyspark.sql import functions as F

from basketlens.operators.customers import first_order_divisions
from basketlens.operators.stats import subscription_curve
from basketlens.session import apply_session_conf, cut_lineage

from helpers import executed_nodes, orders_df

LIMIT = 32e6


def _held(df):
    return [m["dataSize"] for k, m in executed_nodes(df) if k == "BroadcastExchangeExec"]


def test_large_tables_in_small_files_are_not_broadcast(spark):
    # 700,000 rows of two keys in files of a few MB take over 40 MB as a hash table.
    apply_session_conf(spark)
    n = 700_000
    variants = cut_lineage(spark.range(n).select(F.col("id"), (F.col("id") % 50).alias("product_id"), F.concat(F.lit("S-"), F.col("id") % 7).alias("sku"), F.lit(False).alias("is_deleted")))
    products = spark.range(50).select("id", F.lit("shirt").alias("name"), F.lit(False).alias("is_deleted"))
    lines = cut_lineage(spark.range(2 * n).select((F.col("id") % 90).alias("order_id"), (F.col("id") * 3 % n).alias("variant_id"), F.lit(False).alias("is_deleted")))
    orders = orders_df(spark, [(i, f"u{i % 40}@x.com", f"2019-01-{1 + i % 20:02d} 00:00:00", 5.0, i, 0.0) for i in range(90)])
    styles = spark.createDataFrame([("S-1", "kids"), ("S-2", "baby")], "style_code string, division string")
    found = first_order_divisions(orders, lines, variants, products, styles)
    assert {r.email: r.first_order_division for r in found.collect()} == {f"u{i}@x.com": "baby|kids" for i in range(40)}
    assert max(_held(found), default=0) < LIMIT

def test_subscription_curve_of_many_customers_holds_little(spark):
    # Customers met with a table of one row each, as the customer facts are.
    apply_session_conf(spark)
    n = 700_000
    visits = cut_lineage(spark.range(n).select(F.col("id").alias("user"), (F.col("id") % 9 / 2.0).alias("orders_per_year")))
    users = cut_lineage(spark.range(2 * n).select((F.col("id") % n).alias("user"))).join(visits, "user", "left")
    curve = subscription_curve(users)
    assert [(r.new_orders, r.n) for r in curve.collect()] == [(float(v), users.where(F.greatest(F.lit(0.0), 4 - F.floor("orders_per_year")) == v).count()) for v in range(5)]
    assert max(_held(curve), default=0) < LIMIT
