"""The by-day layout is made by one shuffle, without a sampling pass."""
import collections

from basketlens.sources.files import events_by_day, gathered_by_day, write_events_by_day

from helpers import events_df


def test_days_are_gathered_without_sampled_bounds(spark, tmpdir_path):
    ev = events_df(spark, [(f"v{i % 7}", None, "home", f"2019-01-{1 + i % 5:02d} 10:00:00", None, "{}") for i in range(200)]
                   + [(None, "a@x.com", "home", None, None, "{}")])
    plan = gathered_by_day(ev)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(event_date" in plan
    write_events_by_day(ev, tmpdir_path + "/ev")
    back = events_by_day(spark, tmpdir_path + "/ev")
    assert collections.Counter(map(str, back.drop("event_date").collect())) == collections.Counter(map(str, ev.collect()))
    assert back.select("event_date").distinct().count() == 6


def test_order_numbers_are_parsed_only_where_named(spark):
    from basketlens.operators.identity import order_links
    ev = events_df(spark, [("a", None, "x", None, None, '{"order_number":"7"}'), ("b", None, "x", None, None, '{"order\\u005fnumber":"8"}'),
                           ("c", None, "x", None, None, '{"product_id":7}'), ("d", None, "x", None, None, None),
                           ("e", None, "x", None, None, '{"note":"order_number"}'), ("a", None, "y", None, None, '{ "order_number": 7}')])
    links = order_links(ev)
    assert sorted(tuple(r) for r in links.collect()) == [("7", "a"), ("8", "b")]
    assert "Contains(properties" in (plan := links._jdf.queryExecution().optimizedPlan().toString())
    assert plan.index("Contains(properties") < plan.index("get_json_object(properties", plan.index("Filter"))
