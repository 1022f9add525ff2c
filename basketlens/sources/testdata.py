"""Adapter from the driver's generated tables (TPC-H-like star schema plus a
click-stream) to the shop model.

Every expression is deterministic and repeated verbatim by the DuckDB
oracle (``basketlens.plans.oracle.ADAPTER_CTES``). The mapping keeps every
row of every source table; modulo rules only decide attribute values
(soft-delete flags, guest checkouts, mixed-case e-mail, ...), so each query
still scans and processes the whole input.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.tables import ShopTables

# Parameters used with the test data (events cover January 2024; orders,
# shifted by ORDER_SHIFT_DAYS, run from late 2017 to mid 2024).
ORDER_SHIFT_DAYS = 8400
EVENT_WINDOW = ("2024-01-01", "2024-01-31")
SALE_PATTERNS = ("%red%",)
STAFF_PATTERN = "%@staff.example.com%"
PRODUCT_COUNT = 100


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _domain(key):
    return F.when(key % 97 == 0, F.lit("staff.example.com")).otherwise(F.lit("example.com"))


def orders(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    email = (F.when(k % 53 == 0, F.lit(None).cast("string"))
             .when(k % 7 == 0, F.concat(F.lit("Cust"), c.cast("string"), F.lit("@"), F.upper(_domain(c))))
             .otherwise(F.concat(F.lit("cust"), c.cast("string"), F.lit("@"), _domain(c))))
    completed = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("timestamp_ntz")).otherwise(
        F.expr(f"o_orderdate + make_dt_interval({ORDER_SHIFT_DAYS}, cast(o_orderkey % 24 as int), 0, 0)"))
    return o.select(
        k.alias("id"),
        email.alias("email"),
        k.cast("string").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "complete")
         .when(F.col("o_orderstatus") == "O", "returned").otherwise("cart").alias("state"),
        F.when(k % 11 == 0, 1).otherwise(0).cast("int").alias("environment"),
        completed.alias("completed_at"),
        F.when(c % 5 == 0, F.lit(None).cast("long")).otherwise(c).alias("user_id"),
        (F.col("o_totalprice") / 3000.0).alias("item_total"),
        F.when(F.col("o_orderpriority") == "1-URGENT", -10.0)
         .when(F.col("o_orderpriority") == "2-HIGH", -5.0)
         .when(F.col("o_orderpriority") == "5-LOW", 2.5).otherwise(0.0).alias("adjustment_total"),
        (k % 101 == 0).alias("is_deleted"),
    )


def line_items(spark, sf_dir) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("variant_id"),
        price.alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (price * 0.5).alias("cost_price"),
        F.expr(f"l_shipdate + make_dt_interval({ORDER_SHIFT_DAYS}, 0, 0, 0)").alias("created_at"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 89 == 0).alias("is_deleted"),
    )


def variants(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") % PRODUCT_COUNT).alias("product_id"),
        F.concat(F.upper(F.col("p_type")), F.lit("-"), F.col("p_partkey").cast("string")).alias("sku"),
        (F.col("p_partkey") % 89 == 0).alias("is_deleted"),
    )


def products(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    pid = F.col("p_partkey") % PRODUCT_COUNT
    return (p.groupBy(pid.alias("id"))
             .agg(F.min_by("p_name", "p_partkey").alias("name"))
             .select("id",
                     F.when(F.col("id") % 41 == 7, F.lit("fedex delivery"))
                      .when(F.col("id") % 43 == 5, F.lit(None).cast("string"))
                      .otherwise(F.col("name")).alias("name"),
                     (F.col("id") % 37 == 3).alias("is_deleted")))


def product_map(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    division = (F.when(F.col("p_type") == "ECONOMY", "baby")
                .when(F.col("p_type") == "STANDARD", "kids")
                .when(F.col("p_type") == "MEDIUM", "kids")
                .when(F.col("p_type") == "LARGE", "baby")
                .when(F.col("p_type") == "PROMO", "unknown"))
    return (p.select(F.left(F.upper(F.col("p_type")), F.lit(6)).alias("style_code"), division.alias("division"))
             .where(F.col("division").isNotNull()).distinct())


def option_values(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    sizes = p.select(F.col("p_size").cast("long").alias("id"),
                     F.concat(F.lit("size-"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("name"),
                     F.lit(9).alias("option_type_id"))
    brand_no = F.substring(F.col("p_brand"), 7, 8).cast("long")
    colors = p.select((F.lit(1000) + brand_no).alias("id"), F.col("p_brand").alias("name"),
                      F.lit(2).alias("option_type_id"))
    return (sizes.unionByName(colors).distinct()
                 .withColumn("is_deleted", F.col("id") == 13))


def option_values_variants(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    brand_no = F.substring(F.col("p_brand"), 7, 8).cast("long")
    size = p.select(F.col("p_partkey").alias("variant_id"), F.col("p_size").cast("long").alias("option_value_id"),
                    F.lit(False).alias("is_deleted"))
    color = p.select(F.col("p_partkey").alias("variant_id"), (F.lit(1000) + brand_no).alias("option_value_id"),
                     (F.col("p_partkey") % 37 == 0).alias("is_deleted"))
    second = (p.where(F.col("p_partkey") % 10 == 0)
               .select(F.col("p_partkey").alias("variant_id"),
                       (F.col("p_size") % 50 + 1).cast("long").alias("option_value_id"),
                       F.lit(False).alias("is_deleted")))
    return size.unionByName(color).unionByName(second)


def events(spark, sf_dir) -> DataFrame:
    # The JSON text is parsed once a row, not once per use below.
    e = _read(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", F.get_json_object(F.col("props"), "$.k").cast("int").alias("k"))
    u, k = F.col("user_id"), F.col("k")
    t = F.col("event_type")
    name = (F.when(t == "view", F.when(k % 4 == 0, "products.index").when(k % 4 == 1, "products.show")
                   .otherwise("Product viewed"))
             .when(t == "click", "Line items added")
             .when(t == "purchase", F.when(k % 3 == 0, "Started Checkout Process").otherwise("Checkout completed"))
             .when(t == "signup", F.when(k % 2 == 0, "home").otherwise("viewedHomepage"))
             .otherwise("error"))
    email = (F.when(u % 4 == 0, F.lit(None).cast("string"))
             .when(u % 9 == 0, F.concat(F.lit("CUST"), u.cast("string"), F.lit("@"), F.upper(_domain(u))))
             .otherwise(F.concat(F.lit("cust"), u.cast("string"), F.lit("@"), _domain(u))))
    os_ = (F.when(u % 11 == 0, F.lit(None).cast("string"))
           .when(u % 3 == 0, "iOS").when(u % 3 == 1, " Android ").otherwise("Mac OS X"))
    ks = k.cast("string")
    props = (F.when((t == "purchase") & (k < 5),
                    F.concat(F.lit('{"order_number":"'), ks, F.lit('","product_id":'), ks, F.lit("}")))
             .when(t == "error", F.concat(F.lit('{"product_id":"x'), ks, F.lit('"}')))
             .when(t == "signup", F.lit('{"product_id":null}'))
             .otherwise(F.concat(F.lit('{"product_id":'), ks, F.lit("}"))))
    return e.select(
        F.concat(F.lit("v"), u.cast("string")).alias("distinct_id"),
        email.alias("email"),
        name.alias("name"),
        F.col("ts").alias("time"),
        os_.alias("os"),
        props.alias("properties"),
    )


def customer_export(spark, sf_dir) -> DataFrame:
    """The customer export (all text columns, export headers, money as
    ``$1,234.56``) derived from valid orders and their line items."""
    o = orders(spark, sf_dir).where(
        (F.col("is_deleted") == F.lit(False)) & (F.col("state") == "complete")
        & (F.col("environment") == 0) & F.col("completed_at").isNotNull() & F.col("email").isNotNull())
    units = (line_items(spark, sf_dir).where(F.col("is_deleted") == F.lit(False))
             .groupBy("order_id").agg(F.sum("quantity").alias("units")))
    # GPR from an exact integer-cents sum, rounded to cents with plain IEEE
    # steps, so the export text is the same whatever the summation order.
    cents = F.round(F.col("o_totalprice_x100")).cast("long")
    o = o.join(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"),
                                                     (F.col("o_totalprice") * 100).alias("o_totalprice_x100")), "id")
    per_customer = (o.join(units, o.id == units.order_id, "left")
                    .groupBy(F.lower("email").alias("email"))
                    .agg(F.min("completed_at").alias("first"),
                         F.count("id").alias("n"),
                         F.sum(cents).alias("gpr_cents"),
                         F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
                    .withColumn("gpr", F.floor(F.col("gpr_cents") / 300000.0 * 100.0 + 0.5) / 100.0))
    return per_customer.select(
        F.col("email").alias("Customer Filters Email"),
        F.date_format("first", "yyyy-MM-dd").alias("Customer Segments First Order Cohort Date"),
        F.concat(F.lit("$"), F.format_number("gpr", 2)).alias("Customer Segments Lifetime GPR"),
        F.col("n").cast("string").alias("Customer Segments Lifetime Order Count"),
        F.col("units").cast("string").alias("Customer Segments Lifetime Total Units"),
    )


def user_lists(spark, sf_dir) -> dict[str, DataFrame]:
    """Three e-mail lists (one ``email`` column, untidy case and blanks)."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    raw = F.concat(F.lit(" Cust"), k.cast("string"), F.lit("@"), _domain(k), F.lit(" "))
    return {
        "is_picks_buyer": c.where(F.col("c_mktsegment") == "BUILDING").select(raw.alias("email")),
        "is_picks_waitlist": c.where(F.col("c_acctbal") > 5000).select(raw.alias("email")),
        "is_marketing_opt_out": c.where(F.col("c_nationkey") % 5 == 0).select(raw.alias("email")),
    }


def load(spark: SparkSession, sf_dir: str) -> ShopTables:
    return ShopTables(
        orders=orders(spark, sf_dir),
        line_items=line_items(spark, sf_dir),
        variants=variants(spark, sf_dir),
        products=products(spark, sf_dir),
        option_values_variants=option_values_variants(spark, sf_dir),
        option_values=option_values(spark, sf_dir),
        product_map=product_map(spark, sf_dir),
        events=events(spark, sf_dir),
        customer_export=customer_export(spark, sf_dir),
        user_lists=user_lists(spark, sf_dir),
    )

# Long-tenure window for the "middle customers" report (first visit before,
# last visit after), inside the event month of the test data.
TENURE_WINDOW = ("2024-01-10", "2024-01-20")
# Days of the query over the stored daily sketches.
SKETCH_WINDOW = ("2024-01-05", "2024-01-14")
