"""One hand-made case per semantic rule (FIXTURES.md section 4)."""
import datetime as dt

from pyspark.sql import functions as F

from basketlens.functions import buckets as B
from basketlens.functions.coerce import coerce_types, number_rejects
from basketlens.functions.expr import json_int, ratio_pct, time_between
from basketlens.operators import customers as C
from basketlens.operators import orders as O
from basketlens.operators import stats as S
from basketlens.operators import traffic as TR
from basketlens.schemas import OPTION_VALUES, OPTION_VALUES_VARIANTS, PRODUCT_MAP

from helpers import events_df, line_items_df, orders_df, products_df, strings, variants_df


def _order_tables(spark, orders, lines, products=((1, "shirt"), (2, "red sale dress"))):
    o = orders_df(spark, orders)
    li = line_items_df(spark, lines)
    v = variants_df(spark, [(10, 1, "ECONOM-10"), (11, 1, "ECONOM-11"), (20, 2, "STANDA-20")])
    p = products_df(spark, list(products))
    return o, li, v, p


def test_nulls_last_in_first_order(spark):
    o = orders_df(spark, [(1, "a@x.com", None, 10.0, 1, 0.0), (2, "a@x.com", "2019-01-01 00:00:00", 10.0, 1, 0.0)])
    li = line_items_df(spark, [(1, 10, 5.0, 1, "2019-01-01 00:00:00"), (2, 20, 5.0, 1, "2019-01-01 00:00:00")])
    v = variants_df(spark, [(10, 1, "ECONOM-10"), (20, 2, "STANDA-20")])
    p = products_df(spark, [(1, "shirt"), (2, "dress")])
    pm = spark.createDataFrame([("ECONOM", "baby"), ("STANDA", "kids")], PRODUCT_MAP)
    out = C.first_order_divisions(o, li, v, p, pm).collect()
    assert [(r.email, r.first_order_division) for r in out] == [("a@x.com", "kids")]


def test_zero_divisor_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    assert df.select(ratio_pct("a", "b").alias("r")).first().r is None


def test_empty_string_aggregate(spark):
    ovv = spark.createDataFrame([(1, 2001, False), (2, 9001, False)], OPTION_VALUES_VARIANTS)
    ov = spark.createDataFrame([(2001, "Brand#1", 2, False), (9001, "size-04", 9, False)], OPTION_VALUES)
    out = {r.variant_id: (r.size, r.color) for r in C.variant_facts(ovv, ov).collect()}
    assert out == {1: ("", "Brand#1"), 2: ("size-04", "")}


def test_tied_completion_times_lower_id_first(spark):
    o, li, v, p = _order_tables(spark, [(7, "a@x.com", "2019-01-01 10:00:00", 10.0, 1, 0.0),
                                        (5, "a@x.com", "2019-01-01 10:00:00", 10.0, 1, 0.0)],
                                [(7, 10, 5.0, 1, "2019-01-01 00:00:00"), (5, 10, 5.0, 1, "2019-01-01 00:00:00")])
    out = {r.order_id: r.order_index for r in O.order_facts(o, li, v, p).collect()}
    assert out == {5: 1.0, 7: 2.0}


def test_mixed_case_gaps_cross_match(spark):
    rows = [(1, "A@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0), (2, "A@x.com", "2019-01-11 00:00:00", 1.0, 1, 0.0),
            (3, "a@x.com", "2019-01-03 00:00:00", 1.0, 1, 0.0), (4, "a@x.com", "2019-01-04 00:00:00", 1.0, 1, 0.0)]
    g = C.order_gaps(orders_df(spark, rows)).collect()[0]
    # index series per raw address: A: 1->2 (10 days), a: 3->4 (1 day); cross pairs 1->4 (3), 3->2 (8)
    assert (g.min_days_between_orders, g.max_days_between_orders) == (1, 10)
    assert g.avg_days_between_orders == (10 + 1 + 3 + 8) / 4


def test_missing_visit_stats_gives_one_quarter(spark):
    u = spark.createDataFrame([(3.0, None, None)], "lifetime_orders double, days_retained long, "
                                                  "days_retained_per_visit double")
    r = C.retention_fields(u).first()
    assert r.days_retained is None and r.quarters_retained == 1.0 and r.orders_per_quarter == 3.0
    assert r.years_retained == 1.0


def test_duplicated_lines_collapse_and_sale_total(spark):
    o, li, v, p = _order_tables(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 40.0, 1, 0.0)],
                                [(1, 10, 5.0, 3, "2019-01-01 00:00:00"), (1, 10, 5.0, 2, "2019-01-01 00:00:00"),
                                 (1, 20, 9.0, 1, "2019-01-01 00:00:00"), (1, 20, 9.0, 1, "2019-01-01 00:00:00")])
    r = O.order_facts(o, li, v, p, sale_patterns=("%sale%",)).first()
    assert r.units == 4.0          # max(3,2) + max(1,1)
    assert r.line_items == 2.0
    assert r.has_sale_item == 1.0 and r.sale_total == 40.0


def test_sale_total_adds_item_total_per_sale_line(spark):
    o, li, v, p = _order_tables(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 40.0, 1, 0.0)],
                                [(1, 10, 5.0, 1, "2019-01-01 00:00:00"), (1, 20, 9.0, 1, "2019-01-01 00:00:00")],
                                products=((1, "shirt sale"), (2, "red sale dress")))
    assert O.order_facts(o, li, v, p).first().sale_total == 80.0


def test_common_total_adds_price_once(spark):
    o, li, v, p = _order_tables(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 40.0, 1, 0.0),
                                        (2, "a@x.com", "2019-02-01 00:00:00", 40.0, 1, 0.0)],
                                [(1, 10, 5.0, 1, "2019-01-01 00:00:00"), (2, 11, 7.0, 3, "2019-02-01 00:00:00")])
    r = {x.order_id: x for x in O.order_facts(o, li, v, p).collect()}
    assert (r[2].common_products, r[2].common_units, r[2].common_total) == (1.0, 3.0, 7.0)
    assert r[1].common_total == 0.0 and r[2].is_repeat == 1.0 and r[2].order_index_bucket == "2"


def test_end_date_is_midnight(spark):
    ev = events_df(spark, [("d", None, "home", "2019-02-25 00:00:00", None, "{}"),
                           ("d", None, "home", "2019-02-25 00:00:01", None, "{}")])
    assert ev.where(time_between("2019-01-01", dt.date(2019, 2, 25))).count() == 1


def test_identity_fan_out(spark):
    o = orders_df(spark, [(1, "A@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0),
                          (2, "b@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0)])
    ev = events_df(spark, [("d1", None, "Checkout completed", "2019-01-02 00:00:00", "iOS", '{"order_number":"1"}'),
                           ("d1", None, "Checkout completed", "2019-01-03 00:00:00", "iOS", '{"order_number":"2"}'),
                           ("d1", None, "home", "2019-01-04 00:00:00", " Android ", "{}")])
    out = TR.classified_events(o, ev, None, "2019-01-01", "2019-02-01").where(F.col("name") == "home").collect()
    assert sorted(r.email for r in out) == ["a@x.com", "b@x.com"]
    assert {r.platform for r in out} == {"mobile"}


def test_null_email_group_kept_in_visit_stats(spark):
    o = orders_df(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0)])
    ev = events_df(spark, [("d1", None, "home", "2019-01-02 23:50:00", None, "{}"),
                           ("d1", None, "home", "2019-01-03 00:10:00", None, "{}"),
                           ("d2", "X@y.com", "home", "2019-01-02 00:00:00", None, "{}")])
    out = {r.email: r for r in C.visit_stats(o, ev).collect()}
    assert set(out) == {None, "x@y.com"}
    assert out[None].visit_days == 2 and out[None].days_retained == 1   # midnight gap counts one day


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 4, 5, 99, 100, 300]], "x double")
    got = [r.b for r in df.select(B.bucketize("x", B.ORDER_INDEX_EDGES, B.ORDER_INDEX_LABELS, open_top=True).alias("b")).collect()]
    assert got == [None, "2", "4", "5+", "5+", "5+", "5+"]


def test_decile_ties_share_code(spark):
    import pandas as pd
    vals = [1.0] * 60 + [float(2 + i % 7) for i in range(40)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    codes = [r.c for r in B.qcut_codes(df, "x", "c").orderBy("x").collect()]
    assert set(codes[:60]) == {0}
    expected = pd.qcut(pd.Series(sorted(vals)), 10, labels=False, duplicates="drop").tolist()
    assert codes == expected


def test_dense_grid_zero_and_null(spark):
    df = spark.createDataFrame([("1", "<50", 1.0), ("1", "<50", 0.0)], "r string, c string, f double")
    s = {(x.r, x.c): x.value for x in S.cohort_grid(df, "r", "c", ["1", "2"], ["<50", "50-100"], "f", "sum").collect()}
    sh = {(x.r, x.c): x.value for x in S.cohort_grid(df, "r", "c", ["1", "2"], ["<50", "50-100"], "f", "share").collect()}
    assert s == {("1", "<50"): 1, ("1", "50-100"): 0, ("2", "<50"): 0, ("2", "50-100"): 0}
    assert sh[("1", "<50")] == 0.5 and sh[("2", "50-100")] is None


def test_json_key_edge_cases(spark):
    df = spark.createDataFrame([("{}",), ('{"product_id":null}',), ('{"product_id":"abc"}',), ('{"product_id":7}',),
                                ("not json",)], "properties string")
    assert [r.p for r in df.select(json_int("properties", "product_id").alias("p")).collect()] == \
        [None, None, None, 7, None]


def test_csv_money_and_rejects(spark):
    df = spark.createDataFrame([("$1,041.00",), ("",), ("abc",)], strings("lifetime_gpr"))
    types = {"lifetime_gpr": "num"}
    assert [r.lifetime_gpr for r in coerce_types(df, types).collect()] == [1041.0, None, None]
    assert number_rejects(df, types).first().lifetime_gpr == 1


def test_prior_transaction_segments(spark):
    """An order before the event puts the visitor-day in the prior
    segments; the same product only for a bought product."""
    o = orders_df(spark, [(1, "a@x.com", "2019-01-01 00:00:00", 1.0, 1, 0.0)])
    li = line_items_df(spark, [(1, 10, 5.0, 1, "2019-01-01 00:00:00")])
    v = variants_df(spark, [(10, 1, "ECONOM-10")])
    ev = events_df(spark, [
        ("d1", "a@x.com", "Product viewed", "2019-01-05 10:00:00", None, '{"product_id":1}'),
        ("d1", "a@x.com", "Checkout completed", "2019-01-05 11:00:00", None, "{}"),
        ("d2", None, "Product viewed", "2019-01-05 10:00:00", None, '{"product_id":1}')])
    out = {(r.event, r.segment): (r.avg_daily_users, r.avg_daily_converting_users)
           for r in TR.page_conversion(o, li, v, ev, "2019-01-01", "2019-02-01").collect()}
    assert out[("product", "all_users")] == (2.0, 1.0)
    assert out[("product", "prior_transaction")] == (1.0, 1.0)
    assert out[("product", "no_prior_transaction")] == (1.0, 0.0)
    assert out[("product", "prior_transaction_same_product")] == (1.0, 1.0)
    assert out[("checkout", "all_users")] == (1.0, 1.0)


def test_missing_opportunity_pair_fails_the_job(spark):
    import pytest
    from basketlens.plans.reports import opportunity_sizes
    from basketlens.sources.literals import opportunity_map
    conv = spark.createDataFrame([("product", "all_users", 10.0, 0.5)],
                                 "event string, segment string, avg_daily_users double, "
                                 "avg_user_conversion_rate double")
    ok = opportunity_sizes(conv, opportunities=opportunity_map(spark, [("s", "product", "o", "all_users", 0.1)]))
    r = ok.first()
    assert abs(r.new_revenue_yearly - 10.0 * 0.05 * 365 * 60) < 1e-9
    bad = opportunity_sizes(conv, opportunities=opportunity_map(spark, [("s", "bag", "o", "all_users", 0.1)]))
    with pytest.raises(Exception):
        bad.collect()


def test_jitter_bounds(spark):
    from basketlens.functions.expr import jitter
    df = spark.range(200).select(F.lit(5.0).alias("x"))
    vals = [r.j for r in df.select(jitter("x", 0.4).alias("j")).collect()]
    assert all(4.6 <= v <= 5.4 for v in vals) and len(set(vals)) > 1


def test_approx_options_close_to_exact(spark):
    df = spark.createDataFrame([(float(i % 13),) for i in range(1000)], "x double")
    exact = [r.c for r in B.qcut_codes(df, "x", "c").orderBy("x").collect()]
    approx = [r.c for r in B.qcut_codes(df, "x", "c", approx=True).orderBy("x").collect()]
    assert exact == approx
