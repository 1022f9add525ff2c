"""Order facts: lines hashed instead of sorted, one stored row per order and product."""
import random

from basketlens.operators import orders as O

from helpers import executed_nodes, line_items_df, orders_df, products_df, variants_df


def _shop(spark, n=60):
    rng = random.Random(5)
    orders = orders_df(spark, [(i, f"{'U' if i % 3 else 'u'}{i % 9}@x.com", f"2019-01-{1 + i % 20:02d} 00:00:00", 5.0 + i, i if i % 4 else None, 0.5)
                               for i in range(n)])
    rows = [(rng.randrange(n), 10 + rng.randrange(6), float(rng.randrange(1, 9)), rng.randrange(1, 4), f"2019-02-{rng.randrange(1, 28):02d} 00:00:00")
            for _ in range(400)]
    variants = variants_df(spark, [(10 + i, i % 3, f"s{i}") for i in range(6)] + [(11, 2, "again")])
    return orders, rows, line_items_df(spark, rows), variants, products_df(spark, [(0, "shirt"), (1, "big sale"), (2, None)])


def test_lines_are_rolled_up_without_a_sort(spark):
    orders, _, li, v, p = _shop(spark)
    lines = O.order_lines(li, v, p, O.numbered_orders(O.preorders(orders)).localCheckpoint())
    assert not any(k == "SortAggregateExec" for k, _ in executed_nodes(O.order_products(lines)))


def test_rollup_of_order_products_is_that_of_the_lines(spark):
    orders, rows, li, v, p = _shop(spark)
    lines = O.order_lines(li, v, p, O.numbered_orders(O.preorders(orders)))
    items = O.order_products(lines)
    got = {r.order_id: r for r in O.order_rollup(items).collect()}
    product = {10 + i: i % 3 for i in range(6)} | {11: 2}
    best = {}
    for o, variant, price, quantity, created in rows:
        old = best.get((o, variant), (0.0, 0, ""))
        best[o, variant] = (max(old[0], price), max(old[1], quantity), max(old[2], created))
    assert set(got) == {o for o, _ in best}
    for o, r in got.items():
        mine = {variant: best[k, variant] for k, variant in best if k == o}
        # variant 11 also stands for product 1, whose name is a sale
        sales = sum(variant in (11, 14) for variant in mine)
        assert (r.units, r.products, r.line_items) == (sum(q for _, q, _ in mine.values()), len({product[m] for m in mine}), len(mine))
        assert r.order_number == str(o) and r.item_total == 5.0 + o and r.sale_total == sales * (5.0 + o)
        assert str(r.min_line_item_created_at) == min(c for *_, c in mine.values())
    common = [{r.order_id: (r.common_products, r.common_units, r.common_total) for r in O.common_items(t).collect()} for t in (lines, items)]
    assert common[0] == common[1] and common[0]
