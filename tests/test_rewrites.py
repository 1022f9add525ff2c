"""Rewrites checked against brute force on random small inputs."""
import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlens.functions import buckets as B
from basketlens.operators import orders as O
from basketlens.operators import stats as S
from basketlens.operators.sequence import exact_quantiles, sequence_number


def test_sequence_number_matches_row_number_with_hot_key(spark):
    rng = np.random.default_rng(3)
    n = 5000
    keys = np.where(rng.random(n) < 0.4, "hot", np.array([f"k{i}" for i in rng.integers(0, 50, n)]))
    rows = [(None if rng.random() < 0.03 else str(k), int(rng.integers(0, 100)), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    a = sequence_number(df, ["k"], ["t", "id"], "rn", num_partitions=7)
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert a.join(b, "id").where(F.col("rn") != F.col("rn2")).count() == 0
    assert a.count() == n


def test_sequence_number_two_keys(spark):
    rows = [(i % 3, None if i % 5 == 0 else i % 2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, id long")
    a = sequence_number(df, ["a", "b"], ["id"], "rn", num_partitions=5)
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")))
    assert a.join(b, "id").where(F.col("rn") != F.col("rn2")).count() == 0


def test_sequence_number_keeps_wide_keys_beside_nulls_and_nan(spark):
    wide = 2 ** 53
    rows = ([(None, float("nan"), i) for i in range(2)] + [(wide, 1.0, 10 + i) for i in range(2)]
            + [(wide + 1, None, 20 + i) for i in range(3)] + [(wide + 1, float("nan"), 30 + i) for i in range(40)])
    df = spark.createDataFrame(rows, "k long, x double, id long")
    for keys in (["k"], ["x"], ["k", "x"]):
        for parts in (1, 5):
            a = sequence_number(df, keys, ["id"], "rn", num_partitions=parts)
            b = df.withColumn("rn2", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).select("id", "rn2")
            assert a.join(b, "id").where(F.col("rn") == F.col("rn2")).count() == len(rows)


def test_exact_quantiles_with_a_frequent_value_per_group(spark):
    rng = np.random.default_rng(21)
    rows = [("a", 7.0 if rng.random() < 0.6 else float(rng.normal()) * 9) for _ in range(1200)]
    rows += [("b", float(v)) for v in rng.integers(0, 4, 301)] + [("c", 2.5), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, "x", probs, by=["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "c"}
    for g in "abc":
        x = np.array([v for k, v in rows if k == g])
        for p in probs:
            assert abs(got[g, p] - np.percentile(x, p * 100)) < 1e-9
    assert exact_quantiles(df.limit(0), "x", probs).count() == 0


def test_subscription_running_totals_match_a_global_window(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i}", None if i % 17 == 0 else float(rng.integers(0, 60)) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "email string, orders_per_year double")
    got = {r.email: r for r in S.subscription_running_totals(df).collect()}
    users, orders = 0, 0.0
    for email, x in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0])):
        users, orders = users + 1, orders + max(0.0, 4.0 - np.floor(x))
        assert got[email].cumulative_users == users
        assert abs(got[email].cumulative_new_revenue - orders * 68.0) < 1e-6
        assert abs(got[email].cumulative_new_profit - orders * 23.10) < 1e-6
    assert users == len(got)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(3.0, 2001).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.percentile(x, p * 100)) < 1e-9


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(9)
    for trial in range(3):
        x = rng.integers(1, 12, 300).astype(float)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
        got = [r.c for r in B.qcut_codes(df, "x", "c").orderBy("i").collect()]
        assert got == pd.qcut(pd.Series(x), 10, labels=False, duplicates="drop").tolist()


def test_histogram_matches_numpy_auto_bins(spark):
    rng = np.random.default_rng(11)
    x = rng.gamma(2.0, 2.0, 1500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = S.histogram(df, "x").orderBy("bin").collect()
    q75, q25 = np.percentile(x, [75, 25])
    width = 2 * (q75 - q25) / len(x) ** (1 / 3)
    bins = min(int(np.ceil((x.max() - x.min()) / width)), 50)
    counts, _ = np.histogram(x, bins=bins)
    assert [r["count"] for r in h] == counts.tolist()
    assert abs(h[-1].cumulative_fraction - 1.0) < 1e-12


def test_histogram_given_edges(spark):
    x = [0, 0.5, 1, 2, 2.5, 5, 100, 150, -1]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    edges = [0, 1, 2, 3, 5, 10, 15, 20, 30, 100]
    h = S.histogram(df, "x", edges=edges).orderBy("bin").collect()
    counts, _ = np.histogram(x, bins=edges)
    assert [r["count"] for r in h] == counts.tolist()


def test_lifetime_cdf_counts_every_customer(spark):
    from basketlens.plans.reports import lifetime_orders_cdf
    df = spark.range(1, 301).selectExpr("cast(id as double) lifetime_orders")
    h = lifetime_orders_cdf(df).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 300 and h[-1].cumulative_fraction == 1.0


def test_rounding_keeps_large_values(spark):
    from basketlens.plans.registry import rounded
    got = rounded(spark.createDataFrame([(1.5e13,), (1.00000049,), (None,)], "x double")).collect()
    assert [r.x for r in got] == [1.5e13, 1.0, None]


def test_subscription_closed_form_matches_running_sums(spark):
    rng = np.random.default_rng(13)
    opy = np.concatenate([rng.uniform(0, 6, 400), [1.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in opy], "orders_per_year double")
    got = S.subscription_percentiles(df).orderBy("coverage_percentage").collect()
    s = np.sort(opy)[::-1]
    new = np.maximum(0, 4.0 - np.floor(s))
    rev = np.cumsum(new * 68)
    users = np.arange(1, len(s) + 1)
    for r in got:
        p = r.coverage_percentage
        assert abs(r.cumulative_new_revenue - np.percentile(rev, p)) < 1e-6
        assert abs(r.cumulative_users - np.percentile(users, p)) < 1e-9


def test_repeat_purchase_rewrite_matches_exists(spark):
    """First index per (email, product) vs the correlated EXISTS form."""
    rng = np.random.default_rng(17)
    rows = [(int(v), int(o), f"e{int(rng.integers(0, 5))}", int(rng.integers(1, 6)), int(rng.integers(1, 4)),
             float(rng.integers(1, 50)))
            for o in range(60) for v in rng.choice(8, int(rng.integers(1, 4)), replace=False)]
    # order_index must be unique per (email, order): derive it from the order id per email.
    pdf = pd.DataFrame(rows, columns=["variant_id", "order_id", "email", "product_id", "quantity", "price"])
    emails = pdf.groupby("order_id")["email"].first()
    pdf["email"] = pdf["order_id"].map(emails)
    pdf["order_index"] = pdf.groupby("email")["order_id"].rank(method="dense").astype(int)
    pdf = pdf.drop_duplicates(["variant_id", "order_id"])
    lines = spark.createDataFrame(pdf)
    got = {r.order_id: (r.common_products, r.common_units, r.common_total)
           for r in O.common_items(lines).collect()}
    con = duckdb.connect()
    con.register("li", pdf)
    exp = {r[0]: (r[1], r[2], r[3]) for r in con.execute("""
        SELECT new.order_id, count(DISTINCT new.product_id), sum(new.quantity), sum(new.price) FROM li new
        WHERE EXISTS (SELECT 1 FROM li old WHERE new.email = old.email AND new.order_id != old.order_id
                      AND new.product_id = old.product_id AND new.order_index > old.order_index)
        GROUP BY 1""").fetchall()}
    assert got == exp


def test_sequence_number_from_filtered_parquet(spark, tmpdir_path):
    """Input shape (parquet scan + filter + cast) whose two passes Spark would
    not share through exchange reuse; sampled bounds are partial at this size."""
    import os
    rng = np.random.default_rng(21)
    n = 60000
    k = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 3000, n))
    path = os.path.join(tmpdir_path, "seq_in")
    spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(zip(k, rng.integers(0, 10**6, n)))],
                          "k long, t long, id long").repartition(3).write.parquet(path)
    src = spark.read.parquet(path).where(F.col("t") >= 0).select(F.col("k").cast("string").alias("k"), "t", "id")
    a = sequence_number(src, ["k"], ["t", "id"], "rn", num_partitions=16)
    b = src.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert a.join(b, "id").where(F.col("rn") != F.col("rn2")).count() == 0
    g = sequence_number(src.select("t", "id"), [], ["t", "id"], "pos", num_partitions=16)
    assert g.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first() == (1, n, n)
