"""Bootstrap intervals, grids in one pass, stored sketches, rejected rows,
bucketed layout, first rows, report arrays."""
import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.functions.coerce import coerce_types, coerce_with_rejects
from basketlens.operators import stats as S
from basketlens.operators import traffic as TR
from basketlens.operators.orders import order_facts, order_lines, numbered_orders, preorders
from basketlens.schemas import MODEL_SCHEMAS
from basketlens.sources import testdata as td
from basketlens.sources.files import read_report_json
from basketlens.sources.tables import ShopTables, read_model, write_model

from helpers import events_df, executed_nodes

SF = "/root/testdata/sf0.001"


def test_poisson_steps():
    steps = S.poisson_steps()
    draws = np.searchsorted(steps, np.random.default_rng(1).random(200_000), side="right")
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02 and steps == sorted(steps)


def test_bootstrap_interval_is_stable_and_near_the_closed_form(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("x"), (F.randn(3) * 2 + 5).alias("y"))
    df = spark.createDataFrame(df.collect(), df.schema)  # the same rows in every plan below
    closed = {r.x: r for r in S.mean_by(df, "x", "y").collect()}
    boot = S.bootstrap_mean_by(df, "x", "y", row_key=["id"], replicates=400).collect()
    again = S.bootstrap_mean_by(df.repartition(7), "x", "y", row_key=["id"], replicates=400).collect()
    other = S.bootstrap_mean_by(df, "x", "y", row_key=["id"], replicates=400, seed=2).collect()
    assert [(r.x, r.n) for r in boot] == [(0, 2000), (1, 2000)]
    for r, s, t in zip(boot, again, other):
        c, width = closed[r.x], closed[r.x].ci_high - closed[r.x].ci_low
        assert abs(r.mean - c.mean) < 1e-9 and abs(r.std - c.std) < 1e-9
        assert abs(r.ci_low - c.ci_low) < 0.15 * width and abs(r.ci_high - c.ci_high) < 0.15 * width
        assert abs(r.ci_low - s.ci_low) < 1e-9 and abs(r.ci_high - s.ci_high) < 1e-9 and r.ci_low != t.ci_low
    nodes = executed_nodes(S.bootstrap_mean_by(df, "x", "y", row_key=["id"], replicates=400))
    assert sum(m.get("shuffleRecordsWritten", 0) for _, m in nodes) < 4000  # not 4,000 x 100 rows


def test_all_grids_are_one_pass_and_match_one_grid_each(spark, tmpdir_path):
    rng = np.random.default_rng(6)
    rows = [(str(rng.choice(["a", "b", "c", None])), str(rng.choice(["p", "q"])), str(rng.choice(["x", "y", "z"])), None if rng.random() < 0.2 else float(rng.integers(0, 2)), float(rng.integers(0, 5))) for _ in range(400)]
    spark.createDataFrame([tuple(None if v == "None" else v for v in r) for r in rows], "r string, s string, c string, f double, g double").write.parquet(tmpdir_path + "/g")
    df = spark.read.parquet(tmpdir_path + "/g")
    grids = [("n", "r", ["b", "a"], "count", None), ("sum", "s", ["p", "q", "none"], "sum", "f"), ("share", "r", ["a", "b", "c"], "share", "f"),
             ("mean", "s", ["q"], "mean", "g"), ("sum2", "r", ["b", "a"], "sum", "g")]
    grids = [(n, r, ["a", "b", "c"] if r == "r" else ["p", "q", "none"], a, v) for n, r, _, a, v in grids]
    out = S.cohort_grids(df, "c", ["y", "x"], grids)
    got = [(r.grid, r.row_bucket, r.col_bucket, r.value) for r in out.collect()]
    want = [(n, x[r], x["c"], None if x["value"] is None else float(x["value"])) for n, r, labels, a, v in grids for x in S.cohort_grid(df, r, "c", labels, ["y", "x"], v, a).collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(a[3] == b[3] or abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))
    assert [k for k, _ in executed_nodes(out)].count("FileSourceScanExec") == 1


def test_count_grid(spark):
    df = spark.createDataFrame([("1", "<50"), ("1", "<50"), ("2", "100+"), (None, "<50"), ("9", "<50")], "r string, c string")
    got = {(x.r, x.c): x.value for x in S.cohort_grid(df, "r", "c", ["1", "2"], ["<50", "100+"], agg="count").collect()}
    assert got == {("1", "<50"): 2, ("1", "100+"): 0, ("2", "<50"): 0, ("2", "100+"): 1}


def test_stored_sketches_answer_any_dates_without_events(spark, tmpdir_path):
    n = 60_000
    ev = spark.range(n).select(F.concat(F.lit("v"), (F.col("id") * 7919) % 21_000).alias("distinct_id"), F.lit("home").alias("name"),
                               F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 20 as int), cast(id % 24 as int))").alias("time"))
    TR.daily_user_sketches(ev).write.parquet(tmpdir_path + "/sk")
    sketches = spark.read.parquet(tmpdir_path + "/sk")
    for a, b in (("2024-01-01", "2024-01-20"), ("2024-01-04", "2024-01-09"), ("2024-01-07", "2024-01-07")):
        exact = ev.where(F.to_date("time").between(F.lit(a).cast("date"), F.lit(b).cast("date"))).agg(F.countDistinct("distinct_id")).first()[0]
        out = TR.users_between(sketches, a, b)
        assert abs(out.first().users - exact) <= 3 * 1.04 / 2 ** 7 * exact  # three standard errors of 0.8 %
        assert all("/sk/" in f for f in out.inputFiles())


def test_rejected_rows_are_a_second_output_of_one_pass(spark, tmpdir_path):
    rows = [("a", "$1,041.00", "2024-01-01"), ("b", "abc", "2024-01-02"), ("c", "", "soon"), ("d", None, None), ("e", "x1", "never"), ("f", "7", "")]
    spark.createDataFrame(rows, "email string, gpr string, day string").write.parquet(tmpdir_path + "/in")
    df, types = spark.read.parquet(tmpdir_path + "/in"), {"email": "str", "gpr": "num", "day": "ts"}
    clean, rejects, counts = coerce_with_rejects(df, types, ["email"])
    assert {(r.email, r.column, r.value) for r in rejects.collect()} == {("b", "gpr", "abc"), ("c", "day", "soon"), ("e", "gpr", "x1"), ("e", "day", "never")}
    assert counts == {"rows": 6, "gpr": 2, "day": 2}
    assert sorted(map(str, clean.collect())) == sorted(map(str, coerce_types(df, types).collect())) and clean.columns == df.columns
    assert not any("/in" in f for out in (clean, rejects) for f in out.inputFiles())  # the source is read once
    with pytest.raises(ValueError, match="gpr"):
        coerce_with_rejects(df, types, ["email"], strict=True)
    assert coerce_with_rejects(df.limit(0), types, ["email"]).counts == {"rows": 0, "gpr": 0, "day": 0}
    assert coerce_with_rejects(df.select("email"), types, ["email"]).rejects.count() == 0


def _exchanges(df):
    return [k for k, _ in executed_nodes(df) if k == "ShuffleExchangeExec"]


def test_bucketed_model_needs_fewer_shuffles(spark, tmpdir_path):
    t = td.load(spark, SF)
    write_model(t, tmpdir_path + "/model", buckets=4)
    a, b = read_model(spark, tmpdir_path + "/model"), read_model(spark, tmpdir_path + "/model", bucketed=True)
    for name, schema in MODEL_SCHEMAS.items():
        assert [f.dataType for f in getattr(b, name).schema] == [f.dataType for f in schema]
        assert getattr(a, name).count() == getattr(b, name).count() == getattr(t, name).count()

    def lines(m):
        return m.line_items.select("order_id", "variant_id", "quantity").join(preorders(m.orders), "order_id").groupBy("order_id").agg(F.sum("quantity"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(_exchanges(lines(a))) == 2 and _exchanges(lines(b)) == []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # the catalogue fits, orders don't
        plans = [order_lines(m.line_items, m.variants, m.products, numbered_orders(preorders(m.orders)), td.SALE_PATTERNS) for m in (a, b)]
        assert len(_exchanges(plans[1])) < len(_exchanges(plans[0]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    facts = [collections.Counter(map(str, order_facts(m.orders, m.line_items, m.variants, m.products).collect())) for m in (t, b)]
    assert facts[0] == facts[1]


def test_registered_model_answers_sql(spark, tmpdir_path):
    from basketlens.sources.sqlrun import sql_to_df
    td.load(spark, SF).register("m_")
    assert sql_to_df(spark, "select count(*) as N from m_orders where state = %(s)s", s="complete").first().n > 0


def test_first_rows(spark):
    df = spark.createDataFrame([(i * 7 % 10, i) for i in range(10)] + [(None, 99)], "a long, b long")
    assert [r.a for r in S.first_rows(df, 3, "a").collect()] == [0, 1, 2]
    assert [r.a for r in S.first_rows(df, 2, F.desc("a")).collect()] == [9, 8]


def test_report_of_one_indented_array(spark, tmpdir_path):
    with open(tmpdir_path + "/look.json", "w") as f:
        json.dump([{"customer.email": "a@x.com", "orders.count": 3}, {"customer.email": None, "orders.count": 4}], f, indent=2)
    got = read_report_json(spark, tmpdir_path + "/look.json", one_array=True).select("email", "count").collect()
    assert [tuple(r) for r in got] == [("a@x.com", 3), (None, 4)]


def test_heavier_identity_for_a_whole_stream(spark):
    ev = events_df(spark, [(None, "A@x.com", "home", "2019-01-02 00:00:00", None, "{}"), (None, None, "home", "2019-01-03 00:00:00", None, "{}")])
    o = spark.createDataFrame([], MODEL_SCHEMAS["orders"])
    assert [r.email for r in TR.classified_events(o, ev, None, "2019-01-01", "2019-02-01").collect()] == ["a@x.com"]


def test_shop_tables_are_the_model():
    assert set(MODEL_SCHEMAS) <= set(ShopTables.__dataclass_fields__)


def test_guest_mix_evaluates_the_customers_once(spark, tmpdir_path):
    from basketlens.plans.reports import guest_order_mix
    rows = [(f"u{i % 30}", float(i % 30 % 3 == 0), i, 10.0) for i in range(100)] + [("x", None, 500, 1.0)]
    spark.createDataFrame(rows, "email string, is_guest double, order_id long, item_total double").write.parquet(tmpdir_path + "/t")
    out = guest_order_mix(spark.read.parquet(tmpdir_path + "/t"))
    got = {(r.order_count_bucket, r.is_guest): (r.transactions, r.is_guest_transactions) for r in out.collect()}
    # u0..u9 have four orders, the others three; every third one is a guest
    assert len(got) == 14 and got["4", 1.0] == (4, 10) and got["3", 1.0] == (6, 10)
    assert sum(n for (_, g), (n, _) in got.items() if g == 0.0) == 20 and got["11+", 0.0] == (0, 20)
    assert [k for k, _ in executed_nodes(out)].count("FileSourceScanExec") == 1
