import json
import os

from pyspark.sql import functions as F

from basketlens.sources.files import read_csv_text, read_report_json, write_csv
from basketlens.sources.literals import month_starts, opportunity_map
from basketlens.sources.sqlrun import sql_to_df, to_named_markers


def test_sql_to_df_named_params_and_lower_case(spark, tmpdir_path):
    spark.range(10).createOrReplaceTempView("nums")
    path = os.path.join(tmpdir_path, "q.sql")
    with open(path, "w") as f:
        f.write("select id as ID_Value from nums where id between %(start)s and %(end)s")
    df = sql_to_df(spark, "q.sql", sql_dir=tmpdir_path, start=2, end=4)
    assert df.columns == ["id_value"]
    assert sorted(r.id_value for r in df.collect()) == [2, 3, 4]
    assert to_named_markers("a = %(x)s") == "a = :x"


def test_snapshot_cache_keyed_by_source_version(spark, tmpdir_path):
    spark.range(5).createOrReplaceTempView("nums2")
    root = os.path.join(tmpdir_path, "snap")
    a = sql_to_df(spark, "select count(*) as N from nums2", use_cache=True, cache_root=root, source_version="v1")
    assert a.first().n == 5
    spark.range(7).createOrReplaceTempView("nums2")
    same = sql_to_df(spark, "select count(*) as N from nums2", use_cache=True, cache_root=root, source_version="v1")
    newer = sql_to_df(spark, "select count(*) as N from nums2", use_cache=True, cache_root=root, source_version="v2")
    assert same.first().n == 5 and newer.first().n == 7


def test_csv_roundtrip_quoted(spark, tmpdir_path):
    df = spark.createDataFrame([("a@x.com", "$1,041.00"), ('b "q"', "")], "email string, gpr string")
    out = os.path.join(tmpdir_path, "out_csv")
    write_csv(df, out)
    back = read_csv_text(spark, out).orderBy("email").collect()
    assert [(r.email, r.gpr) for r in back] == [("a@x.com", "$1,041.00"), ('b "q"', None)]


def test_report_json_short_names(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "look.json")
    with open(p, "w") as f:
        f.write(json.dumps({"customer.email": "a@x.com", "customer.lifetime_orders": 3}) + "\n")
    df = read_report_json(spark, p)
    assert sorted(df.columns) == ["email", "lifetime_orders"]
    with open(p, "w") as f:
        f.write(json.dumps({"a.email": "x", "b.email": "y"}) + "\n")
    try:
        read_report_json(spark, p)
        raise AssertionError("collision not detected")
    except ValueError:
        pass


def test_month_starts_and_opportunity_map(spark):
    months = [r.month.isoformat() for r in month_starts(spark, "2018-01-15", "2018-04-01").collect()]
    assert months == ["2018-02-01", "2018-03-01", "2018-04-01"]
    assert opportunity_map(spark).count() == 20


def test_streaming_classifier(spark, tmpdir_path):
    from basketlens.sources import testdata as td
    from basketlens.streaming.events import start_classifier
    src = os.path.join(tmpdir_path, "events_in")
    td.events(spark, "/root/testdata/sf0.001").write.parquet(src)
    sink, ck = os.path.join(tmpdir_path, "events_out"), os.path.join(tmpdir_path, "ck")
    q = start_classifier(spark, src, sink, ck, trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    expected = td.events(spark, "/root/testdata/sf0.001").where(
        F.col("name") != "error").count()
    assert out.count() == expected
    assert set(r.event for r in out.select("event").distinct().collect()) <= {
        "product", "bag", "product_list", "home", "checkout_start", "checkout", "other"}


def test_events_by_day_read_only_the_days_in_the_bound(spark, tmpdir_path):
    from basketlens.sources.files import read_events_by_day, write_events_by_day
    from helpers import events_df
    times = ["2024-01-01 10:00:00", "2024-01-02 00:00:00", "2024-01-02 23:59:59", "2024-01-03 12:00:00",
             "2024-01-03 12:00:01", "2024-01-05 08:00:00", None]
    events = events_df(spark, [(f"d{i}", None, "viewed", t, "web", None) for i, t in enumerate(times)])
    write_events_by_day(events, tmpdir_path + "/events")
    got = read_events_by_day(spark, tmpdir_path + "/events", "2024-01-02", "2024-01-03 12:00:00")
    assert got.columns == events.columns
    assert sorted(r.distinct_id for r in got.collect()) == ["d1", "d2", "d3"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
