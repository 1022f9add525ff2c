"""Q1 order facts: one row per completed order with repeat-purchase, sale,
guest and discount facts.

Plan (all joins are equi-joins, every aggregate has a partial phase):
  preorders (A2, P11, P12) -> order_index per e-mail (W1, skew-safe
  sequence numbering) -> line items x variant x product x order (J5-J7,
  inner because the soft-delete filters reject null-extended rows, R1) ->
  roll-up per (variant, order) (A4) -> per (order, product) -> per order (A5).
  Repeat purchases (J14) use the first order index per (e-mail, product): a
  grouped min with a partial phase and a join back, instead of a theta
  self-join.

The lines are shuffled once, by order id, and the roll-ups down to the order's
products run on that partitioning. Texts are grouping columns there: max() of a
text sorts the rows where numbers and times are hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import expr as X
from basketlens.functions.buckets import ORDER_INDEX_EDGES, ORDER_INDEX_LABELS, bucketize
from basketlens.functions.coerce import coerce_types
from basketlens.operators.sequence import sequence_number
from basketlens.schemas import TRANSACTION_TYPES
from basketlens.session import cut_lineage

#: Texts that all lines of an order share.
ORDER_TEXTS = ["email", "order_number"]


def preorders(orders: DataFrame, staff_pattern: str = X.DEFAULT_STAFF_EMAIL_PATTERN) -> DataFrame:
    valid = orders.where(X.valid_order() & ~F.col("email").like(staff_pattern))
    return (valid.groupBy(F.col("id").alias("order_id"))
                 .agg(F.max(F.lower("email")).alias("email"),
                      F.max("completed_at").alias("order_completed_at"),
                      F.max("number").alias("order_number"),
                      F.max("item_total").alias("item_total"),
                      F.max("user_id").alias("user_id"),
                      F.max("adjustment_total").alias("adjustment_total")))


def numbered_orders(pre: DataFrame) -> DataFrame:
    """W1 (+N4 tie-break on order id) and P5. Only (e-mail, time, id) are
    numbered; the index is joined back by order id."""
    n = sequence_number(pre.select("email", "order_completed_at", "order_id"), ["email"],
                        ["order_completed_at", "order_id"], out="order_index")
    return pre.join(n.select("order_id", "order_index"), "order_id").withColumn("is_guest", X.flag(F.col("user_id").isNull()))


def order_lines(line_items: DataFrame, variants: DataFrame, products: DataFrame,
                numbered: DataFrame, sale_patterns=X.SALE_NAME_PATTERNS) -> DataFrame:
    """A4: one row per (variant, order) with max() of every line fact; duplicate
    lines collapse to the larger value, they do not add up."""
    li = line_items.where(X.not_deleted()).select("order_id", "variant_id", "created_at", "price",
                                                  "quantity", "cost_price")
    v = variants.where(X.not_deleted()).select(F.col("id").alias("variant_id"), "product_id")
    p = (products.where(X.not_deleted() & X.merch_product("name"))
                 .select(F.col("id").alias("product_id"), X.flag(X.is_sale_name("name", sale_patterns)).alias("is_sale_item")))
    o = numbered.select("order_id", "email", "is_guest", "adjustment_total", "order_number",
                        "order_completed_at", "item_total", "order_index")
    # Orders first: their lines meet by order id (no shuffle over the bucketed
    # layout), and that partitioning serves the roll-ups as well.
    j = li.join(o, "order_id").join(v, "variant_id").join(p, "product_id")
    lines = j.groupBy("variant_id", "order_id", *ORDER_TEXTS).agg(
        F.max("is_guest").alias("is_guest"),
        F.max("adjustment_total").alias("order_adjustment_total"),
        F.max("product_id").alias("product_id"),
        F.max("order_completed_at").alias("order_completed_at"),
        F.max("item_total").alias("item_total"),
        F.max("order_index").alias("order_index"),
        F.max("created_at").alias("line_item_created_at"),
        F.max("price").alias("price"),
        F.max("quantity").alias("quantity"),
        F.max("cost_price").alias("total"),
        F.max("is_sale_item").alias("is_sale_item"))
    return lines.select("variant_id", "order_id", "email", "is_guest", "order_adjustment_total", "order_number", "product_id",
                        "order_completed_at", "item_total", "order_index", "line_item_created_at", "price", "quantity", "total",
                        "is_sale_item")


def order_products(lines: DataFrame) -> DataFrame:
    """The lines of ``order_lines`` as one row per (order, product): what the
    order roll-up and the repeat-purchase pass both read. ``sale_total`` adds the
    order's item_total once per sale line (N9)."""
    return lines.groupBy("order_id", "product_id", *ORDER_TEXTS).agg(
        F.max("is_guest").alias("is_guest"),
        F.max("order_index").alias("order_index"),
        F.max("order_completed_at").alias("order_completed_at"),
        F.max("item_total").alias("item_total"),
        F.max("order_adjustment_total").alias("order_adjustment_total"),
        F.min("line_item_created_at").alias("min_line_item_created_at"),
        F.max("line_item_created_at").alias("max_line_item_created_at"),
        F.sum("quantity").alias("quantity"),
        F.sum("price").alias("price"),
        F.count(F.lit(1)).alias("line_items"),
        F.max("is_sale_item").alias("has_sale_item"),
        F.sum(F.when(F.col("is_sale_item") > 0.0, F.col("item_total")).otherwise(F.lit(0.0))).alias("sale_total"))


def order_rollup(items: DataFrame) -> DataFrame:
    """A5 from the rows of ``order_products``."""
    return items.groupBy("order_id").agg(
        F.max("email").alias("email"),
        F.max("is_guest").alias("is_guest"),
        F.max("order_number").alias("order_number"),
        F.max("order_index").alias("order_index"),
        F.max("order_completed_at").alias("order_completed_at"),
        F.min("min_line_item_created_at").alias("min_line_item_created_at"),
        F.max("max_line_item_created_at").alias("max_line_item_created_at"),
        F.sum("quantity").alias("units"),
        F.count("product_id").alias("products"),
        F.sum("line_items").alias("line_items"),
        F.max("item_total").alias("item_total"),
        F.max("order_adjustment_total").alias("adjustment_total"),
        F.max("has_sale_item").alias("has_sale_item"),
        F.sum("sale_total").alias("sale_total"))


def common_items(lines: DataFrame) -> DataFrame:
    """J14 + A6: lines (of ``order_lines`` or ``order_products``) whose product
    the same customer bought in an earlier order. Same rows as ``EXISTS(old:
    same email, other order, same product, lower index)`` because the index is
    unique per (email, order).
    ``common_total`` sums unit prices without quantity (N10)."""
    keyed = lines.where(F.col("email").isNotNull() & F.col("product_id").isNotNull())
    first = keyed.groupBy("email", "product_id").agg(F.min("order_index").alias("first_index"))
    # Order numbers start at 1: a first order repeats nothing and stays out of the join.
    rep = (keyed.where(F.col("order_index") > 1).join(first, ["email", "product_id"])
                .where(F.col("order_index") > F.col("first_index")))
    return rep.groupBy("order_id").agg(F.countDistinct("product_id").alias("common_products"),
                                       F.sum("quantity").alias("common_units"),
                                       F.sum("price").alias("common_total"))


def calculate_fields(t: DataFrame) -> DataFrame:
    """D1-D8 on the coerced order table."""
    adj = F.col("adjustment_total")
    return t.select(
        "*",
        X.ratio_pct("common_products", "products").alias("common_products_ratio"),
        X.ratio_pct("common_units", "units").alias("common_units_ratio"),
        X.ratio_pct("common_total", "item_total").alias("common_total_ratio"),
        bucketize("order_index", ORDER_INDEX_EDGES, ORDER_INDEX_LABELS, open_top=True).alias("order_index_bucket"),
        X.flag(F.col("order_index") > 1.0).alias("is_repeat"),
        X.ratio_pct(F.when(adj > 0.0, F.lit(0.0)).otherwise(F.abs(adj)), "item_total").alias("discount_percentage"),
        F.to_date("order_completed_at").alias("order_date"),
        F.trunc(F.col("order_completed_at").cast("date"), "MM").alias("order_month"),
    )


def order_facts(orders: DataFrame, line_items: DataFrame, variants: DataFrame, products: DataFrame,
                staff_pattern: str = X.DEFAULT_STAFF_EMAIL_PATTERN,
                sale_patterns=X.SALE_NAME_PATTERNS) -> DataFrame:
    """Q1: one row per order (the order table of the analysis)."""
    numbered = numbered_orders(preorders(orders, staff_pattern))
    # An order's products feed both the order roll-up and the repeat-purchase
    # pass with different column sets, so Catalyst would plan (and run) the
    # numbering and the joins twice: materialise them once, an order's rows side
    # by side, so that the roll-up shuffles one row per order.
    items = cut_lineage(order_products(order_lines(line_items, variants, products, numbered, sale_patterns)))
    rolled = order_rollup(items)
    common = common_items(items)
    t = rolled.join(common, "order_id", "left").select(
        *[F.col(c) for c in rolled.columns],
        F.coalesce(F.col("common_products").cast("double"), F.lit(0.0)).alias("common_products"),
        F.coalesce(F.col("common_units").cast("double"), F.lit(0.0)).alias("common_units"),
        F.coalesce(F.col("common_total"), F.lit(0.0)).alias("common_total"))
    return calculate_fields(coerce_types(t, TRANSACTION_TYPES))
