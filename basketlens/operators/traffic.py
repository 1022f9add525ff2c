"""Click-stream queries: mean daily users (Q7), views per bag (Q8),
bag likelihood by views (Q9), page conversion by segment (Q6) and the
classified event path table (Q2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import expr as X


def mean_daily_users(events: DataFrame, start, end, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Q7: mean over days of the distinct visitors per page class.

    No name filter, so 'other' is a real class. A day without a class is
    absent, not zero. Plan: partial distinct on (day, event, distinct_id),
    count per (day, event), then a tiny average per event. ``approx=True``
    uses HyperLogLog++ sketches (relative error ``rsd``) instead (A11).
    """
    ev = (X.events_in(events, start, end)
                .select("distinct_id", X.day_of("time").alias("day"), X.page_class().alias("event")))
    distinct = F.approx_count_distinct("distinct_id", rsd) if approx else F.countDistinct("distinct_id")
    daily = ev.groupBy("day", "event").agg(distinct.alias("daily_users"))
    return (daily.groupBy("event").agg(F.avg("daily_users").alias("avg_daily_users"))
                 .orderBy(F.asc_nulls_last("event")))


def daily_user_sketches(events: DataFrame, lg_k: int = 14) -> DataFrame:
    """A11/A12 as stored partial results: per day and page class a distinct
    sketch of its visitors (day, event, visitors: HyperLogLog, at most
    2^lg_k bytes). Kept per day and merged by ``users_between`` over any dates."""
    return (events.where(F.col("time").isNotNull())
                  .groupBy(X.day_of("time").alias("day"), X.page_class().alias("event"))
                  .agg(F.hll_sketch_agg("distinct_id", lg_k).alias("visitors")))


def users_between(sketches: DataFrame, start, end) -> DataFrame:
    """Distinct visitors per page class over the days start..end (both
    included), and the days with any, from ``daily_user_sketches`` alone: no
    event is read. The relative standard error is 1.04 / sqrt(2^lg_k) (0.8 %
    for 14); small sets are counted exactly."""
    return (sketches.where(F.col("day").between(F.date_trunc("day", X.to_ts(start)).cast("timestamp_ntz"), X.to_ts(end)))
                    .groupBy("event").agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("users"),
                                          F.count(F.lit(1)).alias("days"))
                    .orderBy("event"))


def views_per_bag(events: DataFrame, start, end) -> DataFrame:
    """Q8: product views and bag adds per visitor-day (A9 + A17 pivot + P7).

    The fixed-value pivot is one grouped aggregate with conditional sums: an
    absent class stays null, as a pivot leaves it."""
    ev = (X.events_in(events, start, end).where(F.col("name").isin(*X.VIEW_BAG_EVENT_NAMES))
                .select("distinct_id", X.day_of("time").alias("day"), X.page_class_narrow().alias("event")))
    counts = ev.groupBy("distinct_id", "day").agg(
        F.sum(F.when(F.col("event") == "product", F.lit(1))).alias("product"),
        F.sum(F.when(F.col("event") == "bag", F.lit(1))).alias("bag"))
    return counts.withColumn("bag_indicator", X.flag(F.col("bag") > 0))


def bag_likelihood_by_views(events: DataFrame, start, end, bootstrap: int = 0) -> DataFrame:
    """Q9: mean bag indicator per number of product views, with a 95% interval
    (closed form, or with ``bootstrap`` from so many replicates)."""
    from basketlens.operators.stats import bootstrap_mean_by, mean_by
    vpb = views_per_bag(events, start, end)
    means = mean_by(vpb, "product", "bag_indicator") if not bootstrap else bootstrap_mean_by(
        vpb, "product", "bag_indicator", row_key=["distinct_id", "day"], replicates=bootstrap)
    return (means
            .withColumnRenamed("product", "views")
            .withColumnRenamed("mean", "bag_likelihood"))


SEGMENT_ALL = "all_users"
SEGMENT_PRIOR = ("prior_transaction", "no_prior_transaction")
SEGMENT_SAME = ("prior_transaction_same_product", "no_prior_transaction_with_same_product")


def _order_rollup(orders: DataFrame) -> DataFrame:
    """A2: valid orders collapsed to one row per id with max() of each column."""
    return (orders.where(X.valid_order())
                  .groupBy(F.col("id").alias("order_id"))
                  .agg(F.max("completed_at").alias("order_completed_at"),
                       F.max("number").alias("order_number"),
                       F.max(F.lower("email")).alias("email")))


def first_purchases(viewed: DataFrame, vmap: DataFrame, bought: DataFrame) -> DataFrame:
    """J3 + J13: when the customers of a visitor first bought a product, for the
    (visitor, product) pairs that occur in ``viewed``.

    ``vmap`` (email, distinct_id) and ``bought`` (email, product_id, first_at)
    meet only through those pairs, so an e-mail with many products and many
    visitors makes no visitors x products rows."""
    pairs = (viewed.where(F.col("distinct_id").isNotNull() & F.col("product_id").isNotNull())
                   .select("distinct_id", "product_id").distinct())
    return (pairs.join(vmap, "distinct_id").join(bought, ["email", "product_id"])
                 .groupBy("distinct_id", "product_id").agg(F.min("first_at").alias("first_product_at")))


def page_conversion(orders: DataFrame, line_items: DataFrame, variants: DataFrame,
                    events: DataFrame, start, end) -> DataFrame:
    """Q6: daily visitors and converting visitors per page class and segment.

    Rewrites of the analysed SQL (same answer, no correlated probe, one scan):
      * J12/J13: "had an earlier order (of this product)" is the visitor's
        first order time (per product) compared with the event time.
      * Events are pre-aggregated per (visitor, day, class, product) to the
        latest time, since "some event after the first order" only needs it.
      * U2 + J10: one aggregate per visitor-day carries a presence, prior and
        same-product flag per class plus the checkout flag; segments are
        exploded from it, so daily visitors are plain counts.
    """
    from basketlens.operators.identity import visitor_emails

    from basketlens.session import cut_lineage
    # These (and the pre-aggregated events below) are read by several branches
    # with different column sets; they are small next to the click-stream, so
    # materialising them once beats re-planning them.
    rollup = cut_lineage(_order_rollup(orders))
    vmap = cut_lineage(visitor_emails(rollup, events))

    email_first = (rollup.where(F.col("email").isNotNull())
                   .groupBy("email").agg(F.min("order_completed_at").alias("first_at")))
    first_order = (vmap.join(email_first, "email")
                   .groupBy("distinct_id").agg(F.min("first_at").alias("first_order_at")))

    bought = (rollup.where(F.col("email").isNotNull()).select("order_id", "email", "order_completed_at")
              .join(line_items.select("order_id", "variant_id"), "order_id")
              .join(variants.select(F.col("id").alias("variant_id"), "product_id")
                            .where(F.col("product_id").isNotNull()), "variant_id")
              .groupBy("email", "product_id").agg(F.min("order_completed_at").alias("first_at")))
    ev = (X.events_in(events, start, end).where(F.col("name").isin(*X.TRACKED_EVENT_NAMES))
                .select("distinct_id", "time", X.day_of("time").alias("day"),
                        X.page_class().alias("event"),
                        X.json_int("properties", "product_id").alias("pid")))
    ev = ev.withColumn("product_id", F.when(F.col("event") == "product", F.col("pid")).cast("long"))
    pre = cut_lineage(ev.groupBy("distinct_id", "day", "event", "product_id")
                        .agg(F.max("time").alias("last_time")))
    first_product = first_purchases(pre, vmap, bought)
    pre = (pre.join(first_order, "distinct_id", "left")
              .join(first_product, ["distinct_id", "product_id"], "left")
              .select("distinct_id", "day", "event",
                      F.coalesce(F.col("first_order_at") < F.col("last_time"), F.lit(False)).alias("prior"),
                      F.coalesce(F.col("first_product_at") < F.col("last_time"), F.lit(False)).alias("prior_same")))

    classes = [c for c, _ in X.PAGE_CLASSES]
    aggs = []
    for c in classes:
        is_c = F.col("event") == c
        aggs.append(F.max(is_c).alias(f"has_{c}"))
        aggs.append(F.max(is_c & F.col("prior")).alias(f"prior_{c}"))
    aggs.append(F.max((F.col("event") == "product") & F.col("prior_same")).alias("same_product"))
    per_day = pre.groupBy("distinct_id", "day").agg(*aggs)

    def seg(event, segment, present):
        return F.when(present, F.struct(F.lit(event).alias("event"), segment.alias("segment")))

    items = []
    for c in classes:
        has = F.col(f"has_{c}")
        items.append(seg(c, F.lit(SEGMENT_ALL), has))
        items.append(seg(c, F.when(F.col(f"prior_{c}"), SEGMENT_PRIOR[0]).otherwise(SEGMENT_PRIOR[1]), has))
    items.append(seg("product", F.when(F.col("same_product"), SEGMENT_SAME[0]).otherwise(SEGMENT_SAME[1]),
                     F.col("has_product")))
    rows = (per_day.select("distinct_id", "day", F.col("has_checkout").alias("converted"),
                           F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("s"))
                   .select("distinct_id", "day", "converted", "s.event", "s.segment"))
    daily = rows.groupBy("day", "event", "segment").agg(
        F.count("distinct_id").alias("daily_users"),
        F.count(F.when(F.col("converted"), F.col("distinct_id"))).alias("daily_converting_users"))
    return (daily.groupBy("event", "segment")
                 .agg(F.avg("daily_users").alias("avg_daily_users"),
                      F.avg("daily_converting_users").alias("avg_daily_converting_users"),
                      F.count(F.lit(1)).alias("days_counted"))
                 .withColumn("avg_user_conversion_rate",
                             X.safe_div("avg_daily_converting_users", "avg_daily_users"))
                 .orderBy(F.asc_nulls_last("event"), F.asc_nulls_last("segment")))


def classified_events(orders: DataFrame, events: DataFrame, users: DataFrame | None,
                      start, end) -> DataFrame:
    """Q2: events of chosen customers with e-mail, platform, time and the
    path vocabulary name (P3); ``users`` is a DataFrame with ``email``
    (P15: semi joins before the identity join instead of a literal IN list
    after it)."""
    from basketlens.functions.coerce import coerce_types
    from basketlens.operators.identity import email_to_distinct, resolve_email, resolve_email_of
    from basketlens.schemas import EVENT_TYPES

    ev = (X.events_in(events, start, end).where(F.col("name").isin(*X.TRACKED_EVENT_NAMES))
                .select("distinct_id", "email", "os", "time", "name"))
    id_map = email_to_distinct(orders, events)
    ev = resolve_email(ev, id_map) if users is None else resolve_email_of(ev, id_map, users)
    out = ev.select("email", X.platform("os").alias("platform"), "time", "name").where(F.col("email").isNotNull())
    out = out.withColumn("name", X.path_name("name"))
    return coerce_types(out, EVENT_TYPES)
