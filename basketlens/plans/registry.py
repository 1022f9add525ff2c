"""Registry of every implemented query: name -> callable(spark, sf_dir).

Each entry builds the shop model from the driver's tables, runs the
library operator on the whole input and rounds computed doubles to 6
places (the oracle does the same) so floating-point summation order does
not decide equality.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.operators import traffic
from basketlens.sources import testdata as td
from basketlens.sources.files import events_by_day, write_events_by_day
from basketlens.sources.snapshots import Snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # floor(x*10^p + 0.5)/10^p: the same IEEE steps as the oracle, so equal
            # doubles always round equally (no decimal-string half-up rounding).
            scale = float(10 ** places)
            # Beyond 2^53 / 10^p a double has no such place, and stays as it is.
            x = F.col(f.name)
            near = F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)
            cols.append(F.when(F.abs(x) < F.lit(9007199254.0), near).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def model(spark: SparkSession, sf_dir: str):
    """The shop model over the driver's tables (lazy; cheap to rebuild)."""
    return td.load(spark, sf_dir)


def kept(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build, **layout) -> DataFrame:
    """S3: the result ``build()`` of the driver's ``tables``, kept as a snapshot
    until one of their files (or the library) changes."""
    inputs = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
    return Snapshots(spark).get(name, build, inputs, {"sf_dir": sf_dir}, **layout)


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click-stream laid out by day, so date bounds prune partitions."""
    return kept(spark, sf_dir, "events_by_day", ["events"], lambda: td.events(spark, sf_dir),
                write=write_events_by_day, read=events_by_day)


@register("mean_daily_users")
def q_mean_daily_users(spark, sf_dir):
    return rounded(traffic.mean_daily_users(day_events(spark, sf_dir), *td.EVENT_WINDOW))


@register("views_per_bag")
def q_views_per_bag(spark, sf_dir):
    return rounded(traffic.views_per_bag(day_events(spark, sf_dir), *td.EVENT_WINDOW))


@register("bag_likelihood_by_views")
def q_bag_likelihood(spark, sf_dir):
    return rounded(traffic.bag_likelihood_by_views(day_events(spark, sf_dir), *td.EVENT_WINDOW))


@register("page_conversion")
def q_page_conversion(spark, sf_dir):
    m = model(spark, sf_dir)
    return rounded(traffic.page_conversion(m.orders, m.line_items, m.variants, day_events(spark, sf_dir), *td.EVENT_WINDOW))


@register("opportunity_sizes")
def q_opportunity_sizes(spark, sf_dir):
    from basketlens.plans.reports import opportunity_sizes
    m = model(spark, sf_dir)
    conv = traffic.page_conversion(m.orders, m.line_items, m.variants, day_events(spark, sf_dir), *td.EVENT_WINDOW)
    return rounded(opportunity_sizes(conv, aov=60.0))


@register("classified_events")
def q_classified_events(spark, sf_dir):
    from basketlens.functions.coerce import coerce_types, rename_fields
    from basketlens.schemas import CUSTOMER_EXPORT_RENAMES
    m = model(spark, sf_dir)
    users = rename_fields(m.customer_export, CUSTOMER_EXPORT_RENAMES).select("email")
    return traffic.classified_events(m.orders, day_events(spark, sf_dir), users, *td.EVENT_WINDOW)


def order_facts_of(spark, sf_dir):
    from basketlens.operators.orders import order_facts
    m = model(spark, sf_dir)
    return order_facts(m.orders, m.line_items, m.variants, m.products,
                       staff_pattern=td.STAFF_PATTERN, sale_patterns=td.SALE_PATTERNS)


@register("order_facts")
def q_order_facts(spark, sf_dir):
    return rounded(order_facts_of(spark, sf_dir))


def visit_stats_of(spark, sf_dir):
    from basketlens.operators.customers import visit_stats
    m = model(spark, sf_dir)
    return visit_stats(m.orders, m.events)


def first_divisions_of(spark, sf_dir):
    from basketlens.operators.customers import first_order_divisions
    m = model(spark, sf_dir)
    return first_order_divisions(m.orders, m.line_items, m.variants, m.products, m.product_map)


def customer_facts_of(spark, sf_dir):
    from basketlens.operators.customers import customer_facts
    from basketlens.session import cut_lineage
    m = model(spark, sf_dir)
    # The export is a file in production; here it is derived, so written once.
    return customer_facts(cut_lineage(m.customer_export), visit_stats_of(spark, sf_dir), first_divisions_of(spark, sf_dir),
                          m.user_lists)


@register("visit_stats")
def q_visit_stats(spark, sf_dir):
    return rounded(visit_stats_of(spark, sf_dir))


@register("first_order_divisions")
def q_first_order_divisions(spark, sf_dir):
    return first_divisions_of(spark, sf_dir)


@register("variant_facts")
def q_variant_facts(spark, sf_dir):
    from basketlens.operators.customers import variant_facts
    m = model(spark, sf_dir)
    return variant_facts(m.option_values_variants, m.option_values)


@register("customer_facts")
def q_customer_facts(spark, sf_dir):
    return rounded(customer_facts_of(spark, sf_dir))


def _users(spark, sf_dir):
    # Reports share one customer table: the first one writes it.
    return kept(spark, sf_dir, "customer_facts", ["orders", "lineitem", "part", "customer", "events"],
                lambda: customer_facts_of(spark, sf_dir))


def _tx(spark, sf_dir):
    return kept(spark, sf_dir, "order_facts", ["orders", "lineitem", "part"], lambda: order_facts_of(spark, sf_dir))


def _report(name, source, fn):
    @register(name)
    def q(spark, sf_dir):
        return rounded(fn(source(spark, sf_dir)))
    return q


def _register_reports():
    from basketlens.operators import stats as S
    from basketlens.plans import reports as R
    _report("orders_per_year_summary", _users, R.orders_per_year_summary)
    _report("orders_per_year_histogram", _users, R.orders_per_year_histogram)
    _report("subscription_percentiles", _users, S.subscription_percentiles)
    _report("subscription_curve", _users, S.subscription_curve)
    _report("subscription_running_totals", _users, S.subscription_running_totals)
    _report("acquisition_by_month", _users, R.acquisition_by_month)
    _report("lifetime_orders_histogram", _users, R.lifetime_orders_histogram)
    _report("lifetime_orders_histogram_repeat", _users, lambda u: R.lifetime_orders_histogram(u, True))
    _report("lifetime_orders_cdf", _users, R.lifetime_orders_cdf)
    _report("gap_distributions", _users, R.gap_distributions)
    _report("users_by_division", _users, R.users_by_division)
    _report("division_counts", _users, R.division_counts)
    _report("gap_by_lifetime_orders", _users, R.gap_by_lifetime_orders)
    _report("gap_by_lifetime_orders_division", _users, lambda u: R.gap_by_lifetime_orders(u, True))
    _report("quality_onetimers", _users, R.quality_onetimers)
    _report("picks_buyer_grids", _users, lambda u: R.flag_grids(u, "is_picks_buyer"))
    _report("waitlist_grids", _users, lambda u: R.flag_grids(u, "is_picks_waitlist"))
    _report("opt_out_grids", _users, R.opt_out_grids)
    _report("kids_rate_grid", _users, R.kids_rate_grid)
    _report("customer_grids", _users, R.customer_grids)
    _report("top_customers", _users, R.top_customers)
    _report("middle_customers", _users, lambda u: R.middle_customers(u, *td.TENURE_WINDOW))
    _report("customer_export_max", lambda s, d: _export(s, d), lambda e: S.max_per_key(e, "email"))
    _report("repeat_product_mix", _tx, R.repeat_product_mix)
    _report("guest_order_mix", _tx, R.guest_order_mix)
    _report("guest_penetration_grid", _tx, R.guest_penetration_grid)
    _report("sale_orders_by_month", _tx, R.sale_orders_by_month)
    _report("sale_orders_grid", _tx, R.sale_orders_grid)
    _report("units_per_order_histogram", _tx, R.units_per_order_histogram)
    _report("units_per_order_histogram_repeat", _tx, lambda t: R.units_per_order_histogram(t, True))
    _report("units_by_date", _tx, R.units_by_date)
    _report("positive_adjustments", _tx, R.positive_adjustments)
    _report("first_positive_adjustments", _tx, R.first_positive_adjustments)
    _report("orders_by_sale_flag", _tx, R.orders_by_sale_flag)
    _report("guest_penetration_matrix", _tx, R.guest_penetration_matrix)
    _report("nth_multi_order_customer", _users, lambda u: R.nth_customer(u, 100))


def _export(spark, sf_dir):
    from basketlens.functions.coerce import coerce_types, rename_fields
    from basketlens.schemas import CUSTOMER_EXPORT_RENAMES, USER_TYPES
    return coerce_types(rename_fields(model(spark, sf_dir).customer_export, CUSTOMER_EXPORT_RENAMES), USER_TYPES)


_register_reports()


@register("user_paths_top")
def q_user_paths_top(spark, sf_dir):
    from basketlens.plans import reports as R
    m = model(spark, sf_dir)
    chosen = R.top_customers(_users(spark, sf_dir))
    return rounded(R.user_paths(m.orders, day_events(spark, sf_dir), chosen, *td.EVENT_WINDOW))


@register("user_paths_top_visitors")
def q_user_paths_top_visitors(spark, sf_dir):
    """Q13 for the customers with most orders among those seen on the site."""
    from basketlens.plans import reports as R
    chosen = R.top_customers(_users(spark, sf_dir).where(F.col("min_visit_time").isNotNull()))
    return rounded(R.user_paths(model(spark, sf_dir).orders, day_events(spark, sf_dir), chosen, *td.EVENT_WINDOW))


@register("user_paths_middle")
def q_user_paths_middle(spark, sf_dir):
    from basketlens.plans import reports as R
    m = model(spark, sf_dir)
    chosen = R.middle_customers(_users(spark, sf_dir), *td.TENURE_WINDOW)
    return rounded(R.user_paths(m.orders, day_events(spark, sf_dir), chosen, *td.EVENT_WINDOW))


@register("ambiguous_visitors")
def q_ambiguous_visitors(spark, sf_dir):
    from basketlens.operators.identity import ambiguous_visitors, email_to_distinct
    m = model(spark, sf_dir)
    return ambiguous_visitors(email_to_distinct(m.orders, m.events))


@register("event_classes")
def q_event_classes(spark, sf_dir):
    """The streaming classifier's row-wise transform, run in batch over every event."""
    from basketlens.streaming.events import classify
    return classify(model(spark, sf_dir).events)


@register("bag_likelihood_bootstrap")
def q_bag_likelihood_bootstrap(spark, sf_dir):
    return rounded(traffic.bag_likelihood_by_views(day_events(spark, sf_dir), *td.EVENT_WINDOW, bootstrap=200))


@register("users_from_daily_sketches")
def q_users_from_daily_sketches(spark, sf_dir):
    """Distinct visitors of ten days from the stored daily sketches."""
    sketches = kept(spark, sf_dir, "daily_user_sketches", ["events"], lambda: traffic.daily_user_sketches(td.events(spark, sf_dir)))
    return traffic.users_between(sketches, *td.SKETCH_WINDOW)


@register("rejected_product_ids")
def q_rejected_product_ids(spark, sf_dir):
    """Product ids of events that are no numbers, with how often."""
    from basketlens.functions.coerce import coerce_with_rejects
    from basketlens.functions.expr import json_str
    ids = td.events(spark, sf_dir).select("distinct_id", json_str("properties", "product_id").alias("product_id"))
    rejects = coerce_with_rejects(ids, {"product_id": "num"}, ["distinct_id"]).rejects
    return rejects.groupBy("column", "value").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("distinct_id").alias("visitors"))


@register("order_facts_from_buckets")
def q_order_facts_from_buckets(spark, sf_dir):
    """Q1 over the model written in buckets of the order id and read back."""
    from basketlens.operators.orders import order_facts
    from basketlens.session import run_folder
    from basketlens.sources.tables import read_model, write_model
    root = f"{run_folder(spark)}/model-{uuid.uuid4().hex}"
    write_model(model(spark, sf_dir), root, int(spark.conf.get("spark.sql.shuffle.partitions")))
    m = read_model(spark, root, bucketed=True)
    return rounded(order_facts(m.orders, m.line_items, m.variants, m.products,
                               staff_pattern=td.STAFF_PATTERN, sale_patterns=td.SALE_PATTERNS))


@register("sql_orders_by_state")
def q_sql_orders_by_state(spark, sf_dir):
    """SQL text with named and list parameters over the model's views."""
    from basketlens.sources.sqlrun import sql_to_df
    model(spark, sf_dir).register("shop_")
    return sql_to_df(spark, "SELECT state AS State, count(*) AS Orders, count(DISTINCT lower(email)) AS Customers FROM shop_orders "
                            "WHERE completed_at BETWEEN %(start)s AND %(end)s AND array_contains(%(states)s, state) GROUP BY state",
                     start="2020-01-01", end="2022-01-01", states=["complete", "returned"])


def _written(spark, df, write, name):
    from basketlens.session import run_folder
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return path


@register("csv_orders")
def q_csv_orders(spark, sf_dir):
    """Orders written as CSV, read back as text and coerced."""
    from basketlens.functions.coerce import coerce_types
    from basketlens.sources.files import read_csv_text, write_csv
    df = model(spark, sf_dir).orders.select("id", "email", "number", "completed_at", "item_total")
    path = _written(spark, df, write_csv, "csv")
    return rounded(coerce_types(read_csv_text(spark, path, df.columns), {"id": "id", "completed_at": "ts", "item_total": "num"}))


@register("report_json_orders")
def q_report_json_orders(spark, sf_dir):
    """Report rows with dotted names, read under their short names."""
    from basketlens.sources.files import read_report_json
    df = model(spark, sf_dir).orders.select(F.col("id").alias("orders.id"), F.col("state").alias("orders.state"), F.col("email").alias("customer.email"))
    return read_report_json(spark, _written(spark, df, lambda d, p: d.write.json(p), "report"), T.StructType([
        T.StructField("orders.id", T.LongType()), T.StructField("orders.state", T.StringType()), T.StructField("customer.email", T.StringType())]))


@register("sheet_orders_by_state")
def q_sheet_orders_by_state(spark, sf_dir):
    """A small table written as one sheet file and read back."""
    from basketlens.sources.files import read_sheet_export, write_sheet_export
    df = model(spark, sf_dir).orders.groupBy("state").agg(F.count(F.lit(1)).alias("orders"))
    path = _written(spark, df, write_sheet_export, "sheet")
    return read_sheet_export(spark, path).select("state", F.col("orders").cast("long").alias("orders"))


@register("orders_per_month")
def q_orders_per_month(spark, sf_dir):
    """Every month start between the first and the last completed order,
    with its orders (months without any count 0)."""
    from basketlens.sources.literals import month_starts
    orders = model(spark, sf_dir).orders.where(F.col("completed_at").isNotNull())
    first, last = orders.agg(F.date_format(F.min("completed_at"), "yyyy-MM-01"), F.date_format(F.max("completed_at"), "yyyy-MM-dd")).first()
    months = month_starts(spark, first, last).select(F.col("month").cast("date").alias("month"))
    counts = orders.groupBy(F.trunc(F.to_date("completed_at"), "MM").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    return months.join(counts, "month", "left").select("month", F.coalesce("orders", F.lit(0)).alias("orders")).orderBy("month")
