"""Literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The product-opportunity table of the analysis
# (strategy, page class, opportunity, segment, projected lift).
OPPORTUNITY_MAP = [
    ("Delight Inspiration", "product", "Shop the Look", "all_users", 0.02),
    ("Delight Inspiration", "product", "Outfits Module", "all_users", 0.03),
    ("Delight Inspiration", "product", "Pairs Well With  Module", "all_users", 0.02),
    ("Delight Inspiration", "product", "Similar Items Module", "all_users", 0.01),
    ("Delight Inspiration", "bag", "Goes well with Module", "all_users", 0.02),
    ("Delight Inspiration", "bag", "Don't Forget Basics Module", "all_users", 0.01),
    ("Delight Inspiration", "bag", "Overlay Recommendations", "all_users", 0.02),
    ("Utilitarian Inspiration", "product", "Previous Order Reminder", "prior_transaction_same_product", 0.05),
    ("Utilitarian Inspiration", "product", "Reorder Module", "prior_transaction_same_product", 0.05),
    ("Utilitarian Inspiration", "product", "Bundle Builder", "all_users", 0.02),
    ("Utilitarian Inspiration", "product", "Recently Viewed", "all_users", 0.02),
    ("Utilitarian Inspiration", "bag", "Reorder Module", "prior_transaction", 0.05),
    ("Utilitarian Inspiration", "bag", "Recently Viewed", "all_users", 0.02),
    ("Utilitarian Inspiration", "product_list", "Previously Purchased Badges and Filter", "prior_transaction", 0.05),
    ("Reduce Friction", "product", "Size/Color Hints", "prior_transaction_same_product", 0.05),
    ("Reduce Friction", "checkout_start", "Repeat Purchaser Fast Forward", "prior_transaction", 0.05),
    ("Reduce Friction", "bag", "Apple Pay", "all_users", 0.03),
    ("Urgency", "product", "Only X Left", "all_users", 0.01),
    ("Urgency", "bag", "Only X Left", "all_users", 0.01),
    ("Inspiration", "home", "Return Visitor Home Page", "prior_transaction", 0.05),
]

OPPORTUNITY_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("opportunity", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("projected_lift", T.DoubleType()),
])


def opportunity_map(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows if rows is not None else OPPORTUNITY_MAP
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], OPPORTUNITY_SCHEMA)


def month_starts(spark: SparkSession, start, end) -> DataFrame:
    """Month-start dates in [start, end] (start rounded up to a month start)."""
    s = F.lit(str(start)).cast("date")
    first = F.when(F.dayofmonth(s) == 1, s).otherwise(F.add_months(F.trunc(s, "MM"), 1))
    return spark.range(1).select(
        F.explode(F.sequence(first, F.lit(str(end)).cast("date"), F.expr("interval 1 month"))).alias("month"))
