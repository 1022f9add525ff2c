"""Model table schemas and declared column->type maps.

The model follows a shop database: orders, line items, product variants,
products, option values, a style-code -> division map, and a click-stream
event table whose ``properties`` column is a JSON text bag.
"""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("number", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("environment", T.IntegerType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("item_total", T.DoubleType()),
    T.StructField("adjustment_total", T.DoubleType()),
    T.StructField("is_deleted", T.BooleanType()),
])

LINE_ITEMS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("variant_id", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("cost_price", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("is_deleted", T.BooleanType()),
])

VARIANTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("sku", T.StringType()),
    T.StructField("is_deleted", T.BooleanType()),
])

PRODUCTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("is_deleted", T.BooleanType()),
])

OPTION_VALUES_VARIANTS = T.StructType([
    T.StructField("variant_id", T.LongType()),
    T.StructField("option_value_id", T.LongType()),
    T.StructField("is_deleted", T.BooleanType()),
])

OPTION_VALUES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("option_type_id", T.IntegerType()),
    T.StructField("is_deleted", T.BooleanType()),
])

PRODUCT_MAP = T.StructType([
    T.StructField("style_code", T.StringType()),
    T.StructField("division", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("distinct_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("os", T.StringType()),
    T.StructField("properties", T.StringType()),
])

MODEL_SCHEMAS = {
    "orders": ORDERS,
    "line_items": LINE_ITEMS,
    "variants": VARIANTS,
    "products": PRODUCTS,
    "option_values_variants": OPTION_VALUES_VARIANTS,
    "option_values": OPTION_VALUES,
    "product_map": PRODUCT_MAP,
    "events": EVENTS,
}

# Declared coercion maps (kind: "str" | "num" | "ts"). Columns absent from a
# frame are skipped; columns absent from a map keep their type.
TRANSACTION_TYPES = {
    "order_id": "id",
    "order_number": "str",
    "order_index": "num",
    "email": "str",
    "adjustment_total": "num",
    "discount_percentage": "num",
    "is_guest": "num",
    "order_completed_at": "ts",
    "min_line_item_created_at": "ts",
    "max_line_item_created_at": "ts",
    "units": "num",
    "products": "num",
    "line_items": "num",
    "item_total": "num",
    "common_products": "num",
    "common_units": "num",
    "common_total": "num",
    "has_sale_item": "num",
}

EVENT_TYPES = {"email": "str", "name": "str", "platform": "str", "time": "ts"}

USER_TYPES = {
    "email": "str",
    "first_order_date": "ts",
    "first_order_colors": "str",
    "lifetime_gpr": "num",
    "lifetime_orders": "num",
    "lifetime_units": "num",
    "lifetime_aov": "num",
    "days_retained": "num",
    "quarters_retained": "num",
    "days_retained_per_visit": "num",
    "order_frequency": "num",
    "avg_days_between_orders": "num",
    "min_days_between_orders": "num",
    "max_days_between_orders": "num",
    "avg_days_between_visits": "num",
    "min_days_between_visits": "num",
    "max_days_between_visits": "num",
    "is_picks_buyer": "num",
}

# Customer export header -> model column (the export's own column titles).
CUSTOMER_EXPORT_RENAMES = {
    "Customer Filters Email": "email",
    "Customer Segments First Order Cohort Date": "first_order_date",
    "Customer Segments Lifetime Order Count": "lifetime_orders",
    "Customer Segments Lifetime GPR": "lifetime_gpr",
    "Customer Segments Lifetime Total Units": "lifetime_units",
}
