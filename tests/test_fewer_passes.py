"""Steps of the customer table and the histograms that run once instead of twice."""
from pyspark.sql import functions as F

from basketlens import schemas as S
from basketlens.operators import customers as C
from basketlens.operators import skew
from basketlens.operators.sequence import exact_quantiles, sequence_number

from helpers import events_df, executed_nodes, line_items_df, orders_df, products_df, variants_df


def test_visit_days_are_rolled_up_once(spark):
    o = orders_df(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0)])
    days = [("d1", "A@x.com", 2), ("d1", "a@x.com", 2), ("d2", "a@x.com", 5), ("d2", "a@x.com", 12), ("d3", None, 3), ("d3", None, 9)]
    ev = events_df(spark, [(d, e, "home", f"2019-01-{n:02d} 10:00:00", None, "{}") for d, e, n in days])
    out = C.visit_stats(o, ev)
    got = {r.email: (r.visit_days, r.avg_days_between_visits, r.min_days_between_visits, r.max_days_between_visits) for r in out.collect()}
    assert got == {"a@x.com": (3, 5.0, 3, 7), None: (2, None, None, None)}

    def reads(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [distinct_id")
    assert reads(out) == reads(out.select("email", "visit_days"))


def test_heavy_keys_names_no_rare_value(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "a").otherwise(F.col("id").cast("string")).alias("k"))
    assert skew.heavy_keys(df, "k", 0.01) == ["a"]


def test_first_orders_of_customers_with_many_lines(spark):
    o = orders_df(spark, [(1, "A@x.com", "2019-01-03 00:00:00", 1.0, 1, 0.0), (2, "a@x.com", "2019-01-02 00:00:00", 1.0, 1, 0.0),
                          (3, "b@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0), (4, None, "2019-01-01 00:00:00", 1.0, 1, 0.0)])
    li = line_items_df(spark, [(n, v, 1.0, 1, "2019-01-01 00:00:00") for n in (1, 2, 4) for v in (10, 11, 11, 10)] + [(3, 12, 1.0, 1, "2019-01-01 00:00:00")])
    v = variants_df(spark, [(10, 1, "ECONOM-1"), (11, 1, "STANDA-1"), (12, 2, "ECONOM-2")])
    p = products_df(spark, [(1, "shirt"), (2, "fedex delivery")])
    pm = spark.createDataFrame([("ECONOM", "baby"), ("STANDA", "kids")], S.PRODUCT_MAP)
    got = C.first_order_divisions(o, li, v, p, pm).collect()
    assert [tuple(r) for r in got] == [("a@x.com", "baby|kids"), (None, "baby|kids")]
    # the first orders are written, so that their size is known before the lines are shuffled
    plan = C.first_order_divisions(o, li, v, p, pm)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [order_id" in plan


def test_global_positions_need_no_second_shuffle(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("t"), "id")
    out = sequence_number(df, [], ["t"], "rn", num_partitions=6)
    assert [k for k, m in executed_nodes(out) if k == "ShuffleExchangeExec" and m.get("shuffleRecordsWritten", 0) > 100] == []
    assert [r.rn for r in out.orderBy("t").collect()] == list(range(1, 3001))


def test_a_bracket_takes_one_sketch(spark):
    out = exact_quantiles(spark.range(1000).select(F.col("id").cast("double").alias("x")), "x", [0.25, 0.75])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("percentile_approx(") == 1
    assert {r.prob: r.value for r in out.collect()} == {0.25: 249.75, 0.75: 749.25}
