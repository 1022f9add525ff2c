"""Composite reports (Q10-Q29): thin compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.sources.literals import opportunity_map


def opportunity_sizes(conversion: DataFrame, aov: float = 60.0, opportunities: DataFrame | None = None
                      ) -> DataFrame:
    """Q10: size each opportunity from its page/segment metrics.

    delta = rate x lift; daily = users x delta; yearly = daily x 365;
    revenue = yearly x aov. The metric table has at most one row per
    (event, segment); a missing pair fails the job at run time (no driver
    round trip), as the analysis does."""
    opp = opportunities if opportunities is not None else opportunity_map(conversion.sparkSession)
    metrics = conversion.select(F.col("event").alias("page"), "segment", "avg_daily_users",
                                F.col("avg_user_conversion_rate").alias("avg_conversion_rate"))
    # At most one row per page class and segment (13 pairs), whatever the input.
    j = opp.join(F.broadcast(metrics), ["page", "segment"], "left")
    users = F.when(F.col("avg_daily_users").isNull(),
                   F.raise_error(F.concat(F.lit("no metrics for page/segment "), F.col("page"),
                                          F.lit("/"), F.col("segment"))).cast("double")
                   ).otherwise(F.col("avg_daily_users"))
    delta = F.col("avg_conversion_rate") * F.col("projected_lift")
    out = (j.withColumn("avg_daily_users", users)
            .withColumn("delta", delta)
            .withColumn("new_conversions_daily", F.col("avg_daily_users") * F.col("delta"))
            .withColumn("new_conversions_yearly", F.col("new_conversions_daily") * 365.0)
            .withColumn("new_revenue_yearly", F.col("new_conversions_yearly") * float(aov)))
    return out.orderBy("ordinal").select(
        "strategy", "page", "opportunity", "segment", "avg_daily_users", "avg_conversion_rate",
        "projected_lift", "delta", "new_conversions_daily", "new_conversions_yearly", "new_revenue_yearly")


# ---------------------------------------------------------------------------
# Customer-table reports (input: ``customer_facts``)
# ---------------------------------------------------------------------------
from pyspark.sql import Window  # noqa: E402

from basketlens.functions import buckets as B  # noqa: E402
from basketlens.functions import expr as X  # noqa: E402
from basketlens.operators import stats as S  # noqa: E402
from basketlens.operators.sequence import sequence_number  # noqa: E402


def multi_order_candidates(users: DataFrame) -> DataFrame:
    """P20: more than one order and both mean gaps present."""
    return users.where((F.col("lifetime_orders") > 1) & F.col("avg_days_between_orders").isNotNull()
                       & F.col("avg_days_between_visits").isNotNull())


def orders_per_year_summary(users: DataFrame) -> DataFrame:
    """Q11: count, mean, std, min, p10..p90, p95, max of orders per year."""
    return S.summary(users, "orders_per_year")


def orders_per_year_histogram(users: DataFrame) -> DataFrame:
    return S.histogram(users, "orders_per_year")


def acquisition_by_month(users: DataFrame) -> DataFrame:
    """Q14: customers per first-order month."""
    return S.group_sizes(users, "first_order_month", name="users").orderBy("first_order_month")


def lifetime_orders_histogram(users: DataFrame, repeat_only: bool = False) -> DataFrame:
    """Q15: lifetime orders, all customers or multi-order candidates."""
    src = multi_order_candidates(users) if repeat_only else users
    return S.histogram(src, "lifetime_orders")


# Bin edges of the report.
LIFETIME_CDF_EDGES = [0, 1, 2, 3, 5, 10, 15, 20, 30, 100]


def lifetime_orders_cdf(users: DataFrame) -> DataFrame:
    """Q15: cumulative, normalised histogram over fixed edges; the last bin is
    open, so customers beyond 100 orders count."""
    return S.histogram(users, "lifetime_orders", edges=LIFETIME_CDF_EDGES, open_top=True)


def melt_gaps(candidates: DataFrame) -> DataFrame:
    """R-MELT: mean order and visit gaps to (variable in {orders, visits}, value)."""
    m = candidates.unpivot(["email", "lifetime_orders", "first_order_division"],
                           ["avg_days_between_orders", "avg_days_between_visits"], "variable", "value")
    return m.withColumn("variable", F.when(F.col("variable") == "avg_days_between_orders", "orders")
                        .otherwise("visits"))


def gap_distributions(users: DataFrame) -> DataFrame:
    """Q16: histogram and CDF of the mean order gap and mean visit gap of
    multi-order customers, automatic bins per variable."""
    return S.histogram(melt_gaps(multi_order_candidates(users)), "value", by=["variable"])


def users_by_division(users: DataFrame) -> DataFrame:
    """Q17: multi-order customers per first-order division (count plot)."""
    return S.group_sizes(multi_order_candidates(users), "first_order_division", name="users") \
            .orderBy("first_order_division")


def division_counts(users: DataFrame) -> DataFrame:
    """Every customer per first-order division, a missing one as 'na'."""
    return (users.select(F.coalesce(F.col("first_order_division"), F.lit("na")).alias("first_order_division"))
                 .groupBy("first_order_division").agg(F.count(F.lit(1)).alias("users"))
                 .orderBy("first_order_division"))


def gap_by_lifetime_orders(users: DataFrame, by_division: bool = False) -> DataFrame:
    """Q18: mean gap (orders, visits) per lifetime orders [and division]."""
    m = melt_gaps(multi_order_candidates(users))
    if by_division:
        m = m.where(F.col("first_order_division") != "unknown")
        return S.mean_by(m, "lifetime_orders", "value", "variable", "first_order_division")
    return S.mean_by(m, "lifetime_orders", "value", "variable")


def quality_onetimers(users: DataFrame) -> DataFrame:
    """Q20: one-order customers with GPR above 90, per calendar month of the
    first order, as count and percent of all such customers."""
    c = users.where((F.col("lifetime_orders") < 2) & (F.col("lifetime_gpr") > 90.0))
    by_month = (c.select(F.month("first_order_month").alias("month"), "email").where(F.col("month").isNotNull())
                 .groupBy("month").agg(F.count("email").alias("users")))
    total = c.agg(F.count(F.lit(1)).alias("n"))
    return S.pct_of_total(by_month, "users", total, "n").orderBy("month")


def _grid(users, row, row_labels, value, agg):
    return S.cohort_grid(users, row, "lifetime_aov_bucket", row_labels, B.AOV_LABELS, value, agg)


def _lifetime(name, agg, value):
    return name, "lifetime_orders_bucket", B.LIFETIME_ORDERS_LABELS, agg, value


def _quarterly(name, agg, value):
    return name, "orders_per_quarter_bucket", B.ORDERS_PER_QUARTER_LABELS, agg, value


def _grids(users, *grids):
    return S.cohort_grids(users, "lifetime_aov_bucket", B.AOV_LABELS, list(grids))


def flag_grids(users: DataFrame, flag: str) -> DataFrame:
    """Q24/Q26: sum of a 0/1 flag per (lifetime orders bucket x AOV bucket) and
    per (orders-per-quarter bucket x AOV bucket); empty cells are 0."""
    return _grids(users, _lifetime("lifetime_orders", "sum", flag), _quarterly("orders_per_quarter", "sum", flag))


def opt_out_grids(users: DataFrame) -> DataFrame:
    """Q25: opt-out sums, opt-out share of all customers in the cell (empty
    cell -> null), and sums per orders-per-quarter bucket."""
    f = "is_marketing_opt_out"
    return _grids(users, _lifetime("lifetime_orders", "sum", f), _lifetime("lifetime_orders_share", "share", f),
                  _quarterly("orders_per_quarter", "sum", f))


def customer_grids(users: DataFrame) -> DataFrame:
    """Q24-Q27 and the count of customers per cell (A23): every grid of the
    customer reports from one pass over the customers."""
    flags = ("is_picks_buyer", "is_picks_waitlist", "is_marketing_opt_out")
    return _grids(users, _lifetime("customers", "count", None), _quarterly("customers_per_quarter", "count", None),
                  *[_lifetime(f, "sum", f) for f in flags], *[_quarterly(f"{f}_per_quarter", "sum", f) for f in flags],
                  _lifetime("opt_out_share", "share", flags[2]), _lifetime("kids_rate", "mean", "first_order_has_kids"))


def kids_rate_grid(users: DataFrame) -> DataFrame:
    """Q27: mean of first_order_has_kids per cell (empty -> 0)."""
    return _grid(users, "lifetime_orders_bucket", B.LIFETIME_ORDERS_LABELS, "first_order_has_kids", "mean")


def top_customers(users: DataFrame, n: int = 10) -> DataFrame:
    """Q28/O3 + W6: the n customers with most orders (ties by e-mail) with a
    1..n index. A top-k (per-partition heaps), then a window over n rows."""
    top = users.orderBy(F.desc("lifetime_orders"), F.asc("email")).limit(n)
    w = Window.orderBy(F.desc("lifetime_orders"), F.asc("email"))
    return top.select("email", "lifetime_orders", F.row_number().over(w).alias("user_index"))


def middle_customers(users: DataFrame, first_visit_before, last_visit_after, n: int = 10) -> DataFrame:
    """Long-tenured multi-order customers, the n after the midpoint
    of a descending lifetime-orders order. The midpoint slice uses global
    positions (distributed), not OFFSET, which would keep half the rows per
    partition."""
    c = users.where((F.col("lifetime_orders") > 1)
                    & (F.col("min_visit_time") < X.to_ts(first_visit_before))
                    & (F.col("max_visit_time") > X.to_ts(last_visit_after)))
    c = c.select("email", "lifetime_orders", (-F.col("lifetime_orders")).alias("_neg"))
    pos = sequence_number(c, [], ["_neg", "email"], out="_pos")
    mid = c.agg(F.floor(F.count(F.lit(1)) / 2).alias("_mid"))
    j = pos.crossJoin(F.broadcast(mid)).where((F.col("_pos") > F.col("_mid")) & (F.col("_pos") <= F.col("_mid") + n))
    return j.select("email", "lifetime_orders", (F.col("_pos") - F.col("_mid")).alias("user_index"))


def user_paths(orders: DataFrame, events: DataFrame, chosen: DataFrame, start, end,
               event_names=("pdp", "add_to_bag", "checkout"), x_jitter: float | None = None,
               y_jitter: float | None = None) -> DataFrame:
    """Q13: classified events of the chosen customers (email, user_index) with
    epoch seconds, restricted to the given path names; optional jitter."""
    from basketlens.operators.traffic import classified_events
    ev = classified_events(orders, events, chosen.select("email"), start, end)
    ev = ev.join(chosen.select("email", "user_index"), "email").where(F.col("name").isin(*event_names))
    out = ev.select("user_index", "email", "time", X.epoch_seconds("time").alias("epoch"), "name", "platform")
    if x_jitter:
        out = out.withColumn("epoch", X.jitter("epoch", x_jitter, seed=11))
    if y_jitter:
        out = out.withColumn("user_index", X.jitter(F.col("user_index").cast("double"), y_jitter, seed=13))
    return out


# ---------------------------------------------------------------------------
# Order-table reports (input: ``order_facts``)
# ---------------------------------------------------------------------------


def repeat_product_mix(transactions: DataFrame) -> DataFrame:
    """Q19: repeat orders by order-number bucket x share of previously bought
    products (10-point buckets); count and percent of the order bucket."""
    c = transactions.where(F.col("order_index") > 1.0).select(
        B.bucketize("order_index", B.ORDER_INDEX_EDGES, B.ORDER_INDEX_LABELS, open_top=True).alias("order_number"),
        B.bucketize("common_products_ratio", B.RATIO_EDGES, B.RATIO_LABELS).alias("product_ratio_bucket"))
    grid = S.dense_grid(c, "order_number", "product_ratio_bucket", B.ORDER_INDEX_LABELS, B.RATIO_LABELS,
                        {"transactions": F.count(F.lit(1))}, {"transactions": 0})
    totals = S.dense_grid(c.withColumn("_one", F.lit("all")), "order_number", "_one", B.ORDER_INDEX_LABELS,
                          ["all"], {"order_number_total": F.count(F.lit(1))}, {"order_number_total": 0}) \
              .drop("_one")
    out = grid.join(F.broadcast(totals), "order_number")
    return out.withColumn("percentage", X.ratio_pct("transactions", "order_number_total"))


def customer_order_stats(transactions: DataFrame, flag: str, flag_agg: str, flag_name: str) -> DataFrame:
    """Per e-mail a flag roll-up, order count and mean item total,
    with order-count and AOV buckets."""
    agg = F.max(flag) if flag_agg == "max" else F.sum(flag)
    u = transactions.groupBy("email").agg(agg.alias(flag_name), F.count("order_id").alias("orders"),
                                          F.avg("item_total").alias("aov"))
    return u.select("*",
                    B.bucketize("orders", B.LIFETIME_ORDERS_EDGES, B.LIFETIME_ORDERS_LABELS, True)
                    .alias("order_count_bucket"),
                    B.bucketize("aov", B.AOV_EDGES, B.AOV_LABELS, True).alias("aov_bucket"))


def guest_order_mix(transactions: DataFrame) -> DataFrame:
    """Q21: customers per (order-count bucket, guest flag) as percent of all
    customers with that guest flag; every bucket label appears."""
    u = customer_order_stats(transactions, "is_guest", "max", "is_guest").where(F.col("is_guest").isNotNull())
    # One evaluation of the customers: a row per (flag, bucket), then a row per
    # flag that holds its buckets, spread over all labels.
    sizes = u.groupBy("is_guest", "order_count_bucket").agg(F.count(F.lit(1)).alias("n"))
    held = F.collect_list(F.when(F.col("order_count_bucket").isNotNull(), F.struct("order_count_bucket", "n")))
    flags = sizes.groupBy("is_guest").agg(F.sum("n").alias("is_guest_transactions"), F.map_from_entries(held).alias("_held"))
    labels = B.label_table(u.sparkSession, "order_count_bucket", B.LIFETIME_ORDERS_LABELS)
    out = (flags.crossJoin(F.broadcast(labels))
                .select("order_count_bucket", "is_guest",
                        F.coalesce(F.try_element_at("_held", F.col("order_count_bucket")), F.lit(0)).alias("transactions"),
                        "is_guest_transactions", "order_count_bucket_ord"))
    return (out.withColumn("percentage", X.ratio_pct("transactions", "is_guest_transactions"))
               .orderBy("order_count_bucket_ord", "is_guest").drop("order_count_bucket_ord"))


def guest_penetration_grid(transactions: DataFrame) -> DataFrame:
    """Q21: share of guest customers per (AOV bucket, order-count bucket);
    an empty cell is null (0/0)."""
    u = customer_order_stats(transactions, "is_guest", "max", "is_guest")
    g = S.dense_grid(u, "aov_bucket", "order_count_bucket", B.AOV_LABELS, B.LIFETIME_ORDERS_LABELS,
                     {"users": F.count(F.lit(1)), "guest_users": F.count_if(F.col("is_guest") > 0.0)},
                     {"users": 0, "guest_users": 0})
    return g.withColumn("guest_percentage", F.try_divide(F.col("guest_users").cast("double"),
                                                         F.col("users").cast("double")))


def sale_orders_by_month(transactions: DataFrame) -> DataFrame:
    """Q22: orders with a sale item per order month."""
    return S.group_sizes(transactions.where(F.col("has_sale_item") > 0), "order_month", name="orders") \
            .orderBy("order_month")


def sale_orders_grid(transactions: DataFrame) -> DataFrame:
    """Q22: sale orders summed per (order-count bucket, AOV bucket), 0 if empty."""
    u = customer_order_stats(transactions, "has_sale_item", "sum", "sale_orders")
    return S.cohort_grid(u, "order_count_bucket", "aov_bucket", B.LIFETIME_ORDERS_LABELS, B.AOV_LABELS,
                         "sale_orders", "sum")


def units_per_order_histogram(transactions: DataFrame, repeat_only: bool = False) -> DataFrame:
    """Q23: units per order, all orders or repeat orders."""
    src = transactions.where(F.col("is_repeat") > 0.0) if repeat_only else transactions
    return S.histogram(src, "units")


def units_by_date(transactions: DataFrame) -> DataFrame:
    """Q23: mean units per order by order date and repeat flag."""
    return S.mean_by(transactions, "order_date", "units", "is_repeat")


def positive_adjustments(transactions: DataFrame) -> DataFrame:
    """Orders with a positive adjustment."""
    return transactions.where(F.col("adjustment_total") > 0.0)


def orders_by_sale_flag(transactions: DataFrame) -> DataFrame:
    """Orders per has_sale_item value."""
    return S.group_sizes(transactions, "has_sale_item", name="orders").orderBy("has_sale_item")


def guest_penetration_matrix(transactions: DataFrame) -> DataFrame:
    """Q21 as displayed: order-count buckets as rows, AOV buckets as columns."""
    g = guest_penetration_grid(transactions)
    return S.to_wide(g, "order_count_bucket", "aov_bucket", "guest_percentage", B.AOV_LABELS,
                     B.LIFETIME_ORDERS_LABELS)


def nth_customer(users: DataFrame, n: int, order: str = "email") -> DataFrame:
    """The n-th (0-based) multi-order customer in ``order``; global
    positions, so no single-partition sort."""
    c = users.where(F.col("lifetime_orders") > 1)
    # Only the order and the key are numbered; the one row found is joined back.
    pos = sequence_number(c.select(*dict.fromkeys([order, "email"])), [], list(dict.fromkeys([order, "email"])), out="_pos")
    nth = pos.where(F.col("_pos") == n + 1).select("email")
    return c.join(F.broadcast(nth), "email", "left_semi")


def first_positive_adjustments(transactions: DataFrame, n: int = 5) -> DataFrame:
    """The first orders with a positive adjustment, by order id."""
    return S.first_rows(positive_adjustments(transactions), n, "order_id")
