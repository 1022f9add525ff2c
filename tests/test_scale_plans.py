"""Plans that have to hold at scale: pruned days, joins that follow the chosen
customers, no products of unrelated rows, even tasks, no Python passes."""
import collections
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketlens.functions.expr import events_in
from basketlens.operators import identity as I
from basketlens.operators import skew
from basketlens.operators import traffic as TR
from basketlens.operators.orders import order_facts
from basketlens.operators.sequence import exact_quantiles, sequence_number
from basketlens.sources.files import events_by_day, write_events_by_day

from helpers import events_df, executed_nodes, line_items_df, orders_df, products_df, shuffled_records, variants_df


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shop(spark, customers=40, seed=1):
    rng = random.Random(seed)
    orders = orders_df(spark, [(i, f"{'U' if i % 3 else 'u'}{i % customers}@x.com", f"2019-01-{1 + i % 20:02d} 00:00:00", 5.0, i, 0.0)
                               for i in range(3 * customers)])
    names = ["Product viewed", "home", "Line items added", "Checkout completed", "error"]
    rows = []
    for i in range(1500):
        v = rng.randrange(customers)
        props = '{"order_number":"%d"}' % rng.randrange(3 * customers) if rng.random() < 0.1 else '{"product_id":%d}' % rng.randrange(5)
        rows.append((rng.choice([f"v{v}", f"v{v % 5}", None]), rng.choice([None, f"u{v}@x.com", f"U{v}@X.com"]), rng.choice(names),
                     f"2019-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:00", "iOS", props))
    return orders, events_df(spark, rows)


def test_date_bounds_prune_days_in_the_queries(spark, tmpdir_path):
    orders, events = _shop(spark)
    write_events_by_day(events, f"{tmpdir_path}/ev")
    laid, window = events_by_day(spark, f"{tmpdir_path}/ev"), ("2019-01-05", "2019-01-09")
    li, v = line_items_df(spark, [(i, 10 + i % 3, 1.0, 1, "2019-01-01 00:00:00") for i in range(100)]), variants_df(spark, [(10, 1, "a"), (11, 2, "b"), (12, 3, "c")])
    chosen = spark.createDataFrame([("u3@x.com",), ("u4@x.com",)], "email string")
    for run in (lambda e: TR.mean_daily_users(e, *window), lambda e: TR.views_per_bag(e, *window),
                lambda e: TR.classified_events(orders, e, chosen, *window), lambda e: TR.page_conversion(orders, li, v, e, *window)):
        a, b = run(laid), run(events)
        assert collections.Counter(map(str, a.collect())) == collections.Counter(map(str, b.collect()))
    for df in (TR.mean_daily_users(laid, *window), TR.views_per_bag(laid, *window), TR.classified_events(orders, laid, chosen, *window), events_in(laid, *window)):
        assert "PartitionFilters: [isnotnull(event_date" in _plan(df)
    read = [m["numPartitions"] for k, m in executed_nodes(events_in(laid, *window)) if k == "FileSourceScanExec"]
    assert read == [5]  # of 28 days


def test_chosen_customers_are_cut_out_before_the_identity_join(spark):
    orders, events = _shop(spark)
    full = I.resolve_email(events, I.email_to_distinct(orders, events)).where(F.col("email").isNotNull())
    for names in (["u3@x.com"], [f"u{i}@x.com" for i in range(0, 40, 2)], ["none@x.com"]):
        chosen = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "email string")
        got = I.resolve_email_of(events, I.email_to_distinct(orders, events), chosen)
        want = full.where(F.col("email").isin(names)).select(*got.columns)
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_shuffled_rows_follow_the_chosen_customers(spark):
    rows = [(f"v{i % 900}", f"u{i % 900}@x.com" if i % 2 else None, "home", "2019-01-05 00:00:00", "iOS", '{"order_number":"%d"}' % (i % 900) if i < 900 else "{}") for i in range(20_000)]
    events = events_df(spark, rows)
    orders = orders_df(spark, [(i, f"u{i}@x.com", "2019-01-01 00:00:00", 1.0, i, 0.0) for i in range(900)])

    def moved(n):
        chosen = spark.createDataFrame([(f"u{i}@x.com",) for i in range(n)], "email string")
        return shuffled_records(TR.classified_events(orders, events, chosen, "2019-01-01", "2019-02-01"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # the list of 900 is beyond it
    try:
        few, all_ = moved(2), moved(900)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert few < 2_000 and all_ > 20_000  # 20,000 events in both


def test_one_customer_of_many_products_and_visitors_makes_no_products_of_them(spark):
    n = 300
    viewed = spark.createDataFrame([(f"v{i}", i % n) for i in range(n)] + [("v0", None), (None, 1)], "distinct_id string, product_id long")
    vmap = spark.createDataFrame([("shop@x.com", f"v{i}") for i in range(n)], "email string, distinct_id string")
    bought = spark.createDataFrame([("shop@x.com", p, p) for p in range(n)], "email string, product_id long, first_at long")
    nodes = executed_nodes(TR.first_purchases(viewed, vmap, bought))
    assert max(m.get("numOutputRows", 0) for _, m in nodes) <= n + 2  # not 90,000
    got = {(r.distinct_id, r.product_id): r.first_product_at for r in TR.first_purchases(viewed, vmap, bought).collect()}
    assert got == {(f"v{i}", i): i for i in range(n)}


def test_first_purchases_match_the_join_by_customer(spark):
    rng = random.Random(7)
    viewed = spark.createDataFrame([(f"v{rng.randrange(30)}", rng.randrange(12)) for _ in range(200)], "distinct_id string, product_id long")
    vmap = spark.createDataFrame(sorted({(f"e{rng.randrange(15)}", f"v{rng.randrange(30)}") for _ in range(60)}), "email string, distinct_id string")
    bought = spark.createDataFrame([(f"e{e}", p, rng.randrange(1000)) for e in range(15) for p in rng.sample(range(12), 4)], "email string, product_id long, first_at long")
    every = vmap.join(bought, "email").groupBy("distinct_id", "product_id").agg(F.min("first_at").alias("first_product_at"))
    want = every.join(viewed.distinct(), ["distinct_id", "product_id"])
    key = lambda r: (r.distinct_id, r.product_id, r.first_product_at)
    assert sorted(map(key, TR.first_purchases(viewed, vmap, bought).collect())) == sorted(map(key, want.collect()))


def test_visitors_missing_or_heavy_leave_even_tasks(spark):
    n = 24_000
    who = F.when(F.col("id") % 10 < 6, F.lit(None)).when(F.col("id") % 10 < 9, F.lit("kiosk")).otherwise(F.concat(F.lit("v"), F.col("id") % 97))
    events = spark.range(n, numPartitions=8).select(who.alias("distinct_id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("E"), F.col("id"))).alias("email"), F.col("id").alias("time"))
    id_map = spark.createDataFrame([("kiosk", "a@x.com"), ("kiosk", "b@x.com"), ("v3", "c@x.com")], "distinct_id string, email string")
    assert "kiosk" in skew.heavy_keys(events, "distinct_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        got = I.resolve_email(events, id_map)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        plain = events.join(id_map.withColumnRenamed("email", "m"), "distinct_id", "left").withColumn("email", F.coalesce(F.lower("email"), "m")).drop("m")
        piled = [r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(piled) > 0.4 * sum(piled) and max(sizes) < 0.2 * sum(sizes)
    assert collections.Counter(map(tuple, got.select("distinct_id", "email", "time").collect())) == collections.Counter(map(tuple, plain.select("distinct_id", "email", "time").collect()))


def test_heavy_keys_finds_every_frequent_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 50 == 1, "b").when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
    found = skew.heavy_keys(df, "k", 0.015)
    assert {"a", "b"} <= set(found) and len(found) <= 1 / 0.015 + 1
    assert skew.heavy_keys(df.limit(0), "k") == []


def test_numbering_has_no_python_pass(spark):
    o = orders_df(spark, [(i, f"u{i % 7}@x.com" if i % 3 else "hot@x.com", f"2019-01-{1 + i % 20:02d} 00:00:00", 5.0, i, 0.0) for i in range(200)])
    li = line_items_df(spark, [(i, 10, 1.0, 1, "2019-01-01 00:00:00") for i in range(200)])
    df = order_facts(o, li, variants_df(spark, [(10, 1, "a")]), products_df(spark, [(1, "shirt")]))
    assert not any("Arrow" in k or "Pandas" in k or "Python" in k for k, _ in executed_nodes(df))
    numbered = sequence_number(o.select("email", "completed_at", "id"), ["email"], ["completed_at", "id"], num_partitions=9)
    assert not any("Python" in k or "Arrow" in k for k, _ in executed_nodes(numbered))
    want = o.select("id", F.row_number().over(Window.partitionBy("email").orderBy("completed_at", "id")).alias("w"))
    assert numbered.join(want, "id").where(F.col("rn") != F.col("w")).count() == 0


def test_quantiles_of_a_continuous_column_write_nothing(spark):
    n = 400_000
    df = spark.range(n, numPartitions=8).select((F.exp(F.randn(5) * 2) * 1000).alias("x"))
    df.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/q-{random.random()}")
    df = spark.read.parquet(path)
    probs = [0.0, 0.00005, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99999, 1.0]
    x = np.array([r.x for r in df.collect()])
    out = exact_quantiles(df, "x", probs)
    assert all(abs(r.value - np.quantile(x, r.prob)) <= 1e-9 * abs(r.value) for r in out.collect()) and out.count() == len(probs)
    nodes = executed_nodes(out)
    assert not any("WriteFiles" in k or "InsertInto" in k for k, _ in nodes)
    assert sum(m.get("shuffleRecordsWritten", 0) for _, m in nodes) < 0.2 * n  # nine brackets of some 0.04 % a task, the rest counts
