"""DuckDB oracle SQL.

``ADAPTER_CTES`` repeats the test-data adapter of
``basketlens.sources.testdata`` over the driver's pre-registered views. Each
oracle query is written from the definitions with a structure of its own, so
that it checks the Spark plans. Computed doubles are rounded to 6 places on
both sides.
"""

from __future__ import annotations

from basketlens.functions.expr import (MOBILE_OS, NON_MERCH_PRODUCTS, PAGE_CLASSES,
                                       PATH_NAMES, TRACKED_EVENT_NAMES, VIEW_BAG_EVENT_NAMES)
from basketlens.sources import testdata as td

S, E = td.EVENT_WINDOW


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def class_case(col: str = "name", narrow: bool = False) -> str:
    parts = [f"WHEN {col} IN ({q(names)}) THEN '{label}'" for label, names in PAGE_CLASSES
             if not narrow or label in ("product", "bag")]
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


def path_case(col: str = "name") -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in PATH_NAMES.items()) + f" ELSE {col} END"


TRACKED = q(TRACKED_EVENT_NAMES)
VIEW_BAG = q(VIEW_BAG_EVENT_NAMES)
MOBILE = q(MOBILE_OS)
NON_MERCH = q(NON_MERCH_PRODUCTS)
TS_START = f"TIMESTAMP '{S} 00:00:00'"
TS_END = f"TIMESTAMP '{E} 00:00:00'"


def _dom(k: str) -> str:
    return f"(CASE WHEN {k} % 97 = 0 THEN 'staff.example.com' ELSE 'example.com' END)"


ADAPTER_CTES = f"""
m_orders AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         WHEN o_orderkey % 7 = 0 THEN concat('Cust', CAST(o_custkey AS VARCHAR), '@', upper({_dom('o_custkey')}))
         ELSE concat('cust', CAST(o_custkey AS VARCHAR), '@', {_dom('o_custkey')}) END AS email,
    CAST(o_orderkey AS VARCHAR) AS number,
    CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'returned' ELSE 'cart' END AS state,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS environment,
    CASE WHEN o_orderstatus = 'P' THEN NULL
         ELSE o_orderdate + to_days({td.ORDER_SHIFT_DAYS}) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) END AS completed_at,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS user_id,
    o_totalprice / CAST(3000.0 AS DOUBLE) AS item_total,
    CASE WHEN o_orderpriority = '1-URGENT' THEN -10.0 WHEN o_orderpriority = '2-HIGH' THEN -5.0
         WHEN o_orderpriority = '5-LOW' THEN 2.5 ELSE 0.0 END::DOUBLE AS adjustment_total,
    (o_orderkey % 101 = 0) AS is_deleted
  FROM orders),
m_line_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS variant_id, l_extendedprice / l_quantity AS price,
    CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity * 0.5 AS cost_price,
    l_shipdate + to_days({td.ORDER_SHIFT_DAYS}) AS created_at,
    ((l_orderkey * 7 + l_linenumber) % 89 = 0) AS is_deleted
  FROM lineitem),
m_variants AS (
  SELECT p_partkey AS id, p_partkey % {td.PRODUCT_COUNT} AS product_id,
    concat(upper(p_type), '-', CAST(p_partkey AS VARCHAR)) AS sku, (p_partkey % 89 = 0) AS is_deleted
  FROM part),
m_products_raw AS (
  SELECT p_partkey % {td.PRODUCT_COUNT} AS id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1),
m_products AS (
  SELECT id, CASE WHEN id % 41 = 7 THEN 'fedex delivery' WHEN id % 43 = 5 THEN NULL ELSE name END AS name,
    (id % 37 = 3) AS is_deleted
  FROM m_products_raw),
m_product_map AS (
  SELECT DISTINCT left(upper(p_type), 6) AS style_code,
    CASE WHEN p_type = 'ECONOMY' THEN 'baby' WHEN p_type = 'STANDARD' THEN 'kids' WHEN p_type = 'MEDIUM' THEN 'kids'
         WHEN p_type = 'LARGE' THEN 'baby' WHEN p_type = 'PROMO' THEN 'unknown' END AS division
  FROM part
  WHERE p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO')),
m_option_values AS (
  SELECT id, name, option_type_id, (id = 13) AS is_deleted FROM (
    SELECT DISTINCT CAST(p_size AS BIGINT) AS id, concat('size-', lpad(CAST(p_size AS VARCHAR), 2, '0')) AS name,
      9 AS option_type_id FROM part
    UNION
    SELECT DISTINCT 1000 + CAST(substring(p_brand, 7, 8) AS BIGINT), p_brand, 2 FROM part)),
m_option_values_variants AS (
  SELECT p_partkey AS variant_id, CAST(p_size AS BIGINT) AS option_value_id, false AS is_deleted FROM part
  UNION ALL
  SELECT p_partkey, 1000 + CAST(substring(p_brand, 7, 8) AS BIGINT), (p_partkey % 37 = 0) FROM part
  UNION ALL
  SELECT p_partkey, CAST(p_size % 50 + 1 AS BIGINT), false FROM part WHERE p_partkey % 10 = 0),
m_events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m_events AS (
  SELECT concat('v', CAST(user_id AS VARCHAR)) AS distinct_id,
    CASE WHEN user_id % 4 = 0 THEN NULL
         WHEN user_id % 9 = 0 THEN concat('CUST', CAST(user_id AS VARCHAR), '@', upper({_dom('user_id')}))
         ELSE concat('cust', CAST(user_id AS VARCHAR), '@', {_dom('user_id')}) END AS email,
    CASE WHEN event_type = 'view' THEN (CASE WHEN k % 4 = 0 THEN 'products.index' WHEN k % 4 = 1 THEN 'products.show'
                                             ELSE 'Product viewed' END)
         WHEN event_type = 'click' THEN 'Line items added'
         WHEN event_type = 'purchase' THEN (CASE WHEN k % 3 = 0 THEN 'Started Checkout Process'
                                                 ELSE 'Checkout completed' END)
         WHEN event_type = 'signup' THEN (CASE WHEN k % 2 = 0 THEN 'home' ELSE 'viewedHomepage' END)
         ELSE 'error' END AS name,
    ts AS time,
    CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'iOS' WHEN user_id % 3 = 1 THEN ' Android '
         ELSE 'Mac OS X' END AS os,
    CASE WHEN event_type = 'purchase' AND k < 5
           THEN concat('{{"order_number":"', CAST(k AS VARCHAR), '","product_id":', CAST(k AS VARCHAR), '}}')
         WHEN event_type = 'error' THEN concat('{{"product_id":"x', CAST(k AS VARCHAR), '"}}')
         WHEN event_type = 'signup' THEN '{{"product_id":null}}'
         ELSE concat('{{"product_id":', CAST(k AS VARCHAR), '}}') END AS properties
  FROM m_events_k)
"""


def with_adapter(body_ctes: str, final: str) -> str:
    """Compose ``WITH <adapter>, <body ctes> <final select>``."""
    ctes = ADAPTER_CTES.strip()
    if body_ctes.strip():
        ctes += ",\n" + body_ctes.strip().rstrip(",")
    return f"WITH {ctes}\n{final}"


ORACLE: dict[str, str] = {}





def expand_rounding(sql: str) -> str:
    """``__R6__(x)__R6END__`` marks a computed double rounded as on the Spark side."""
    opened, closed = "__R6__(", ")__R6END__"
    while opened in sql:
        a = sql.rindex(opened)  # innermost first
        b = sql.index(closed, a)
        sql = sql[:a] + ROUNDED.format("(" + sql[a + len(opened):b] + ")::DOUBLE") + sql[b + len(closed):]
    return sql


# Values beyond 2^53 / 1e6 have no sixth place to round and stay as they are.
ROUNDED = ("list_transform([{0}], lambda x: if(abs(x) < 9007199254.0, floor(x * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE))"
            " / CAST(1e6 AS DOUBLE) + CAST(0.0 AS DOUBLE), x))[1]")


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = expand_rounding(fn())
        return fn
    return deco


# --- Q7: mean daily users per page class ----------------------------------
@oracle("mean_daily_users")
def _mean_daily_users():
    return with_adapter(f"""
ev AS (
  SELECT distinct_id, CAST(CAST(time AS DATE) AS TIMESTAMP) AS day, {class_case()} AS event
  FROM m_events WHERE time BETWEEN {TS_START} AND {TS_END}),
days AS (SELECT day, event, count(DISTINCT distinct_id) AS daily_users FROM ev GROUP BY 1, 2)
""", "SELECT event, __R6__(avg(daily_users))__R6END__ AS avg_daily_users FROM days GROUP BY 1 ORDER BY 1")


# --- Q8 / Q9: views per bag and bag likelihood ------------------------------
VIEWS_PER_BAG_CTES = f"""
event_counts AS (
  SELECT distinct_id, CAST(CAST(time AS DATE) AS TIMESTAMP) AS day, {class_case(narrow=True)} AS event,
    count(1) AS event_count
  FROM m_events
  WHERE time BETWEEN {TS_START} AND {TS_END} AND name IN ({VIEW_BAG})
  GROUP BY 1, 2, 3),
pivoted AS (
  SELECT * FROM (PIVOT event_counts ON event IN ('product', 'bag', 'other') USING sum(event_count)
                 GROUP BY distinct_id, day)),
vpb AS (
  SELECT distinct_id, day, CAST(product AS BIGINT) AS product, CAST(bag AS BIGINT) AS bag,
    CASE WHEN bag > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS bag_indicator
  FROM pivoted)
"""


@oracle("views_per_bag")
def _views_per_bag():
    return with_adapter(VIEWS_PER_BAG_CTES, "SELECT * FROM vpb")


Z95 = "1.959963984540054"


@oracle("bag_likelihood_by_views")
def _bag_likelihood():
    return with_adapter(VIEWS_PER_BAG_CTES + f""",
g AS (
  SELECT product AS views, avg(bag_indicator) AS m, count(bag_indicator) AS n, stddev_samp(bag_indicator) AS s
  FROM vpb WHERE product IS NOT NULL AND bag_indicator IS NOT NULL GROUP BY 1)
""", f"""SELECT views, __R6__(m)__R6END__ AS bag_likelihood, n, __R6__(s)__R6END__ AS std,
  __R6__(m - {Z95} * s / sqrt(n))__R6END__ AS ci_low, __R6__(m + {Z95} * s / sqrt(n))__R6END__ AS ci_high
FROM g ORDER BY views""")


# --- Q6: page conversion by segment (first purchase per visitor, then one row per visitor-day and page) ---
VALID_ORDER = "is_deleted = false AND state = 'complete' AND environment = 0 AND completed_at IS NOT NULL"

PAGE_CONVERSION_CTES = f"""
buyers AS (SELECT id, number, lower(email) AS email, completed_at FROM m_orders WHERE {VALID_ORDER} AND email IS NOT NULL),
known AS (
  SELECT distinct_id, lower(email) AS email FROM m_events WHERE email IS NOT NULL
  UNION
  SELECT e.distinct_id, b.email FROM buyers b JOIN m_events e ON b.number = json_extract_string(e.properties, '$.order_number')),
first_order AS (SELECT distinct_id, min(completed_at) AS since FROM known JOIN buyers USING (email) GROUP BY ALL),
first_item AS (
  SELECT distinct_id, product_id, min(completed_at) AS since
  FROM known JOIN buyers b USING (email) JOIN m_line_items li ON li.order_id = b.id JOIN m_variants v ON v.id = li.variant_id
  GROUP BY ALL),
page_days AS (
  SELECT e.distinct_id, CAST(e.time AS DATE) AS day, {class_case('e.name')} AS page,
    bool_or(coalesce(e.time > o.since, false)) AS bought, bool_or(coalesce(e.time > i.since, false)) AS bought_it
  FROM m_events e
    LEFT JOIN first_order o ON o.distinct_id = e.distinct_id
    LEFT JOIN first_item i ON i.distinct_id = e.distinct_id AND i.product_id = TRY_CAST(json_extract_string(e.properties, '$.product_id') AS INTEGER)
  WHERE e.time BETWEEN {TS_START} AND {TS_END} AND e.name IN ({TRACKED})
  GROUP BY ALL),
segmented AS (
  SELECT day, page, distinct_id, bool_or(page = 'checkout') OVER (PARTITION BY distinct_id, day) AS ordered,
    unnest(['all_users', if(bought, 'prior_transaction', 'no_prior_transaction')]
      || CASE WHEN page <> 'product' THEN []
              ELSE [if(bought_it, 'prior_transaction_same_product', 'no_prior_transaction_with_same_product')] END) AS segment
  FROM page_days),
per_day AS (
  SELECT day, page, segment, count(distinct_id) AS visitors, count(distinct_id) FILTER (ordered) AS converted
  FROM segmented GROUP BY ALL),
page_rates AS (
  SELECT page AS event, segment, avg(visitors) AS avg_daily_users, avg(converted) AS avg_daily_converting_users,
    count(*) AS days_counted, avg(converted) / nullif(avg(visitors), 0) AS avg_user_conversion_rate
  FROM per_day GROUP BY ALL)
"""


@oracle("page_conversion")
def _page_conversion():
    return with_adapter(PAGE_CONVERSION_CTES, """
SELECT event, segment, __R6__(avg_daily_users)__R6END__ AS avg_daily_users,
  __R6__(avg_daily_converting_users)__R6END__ AS avg_daily_converting_users, days_counted,
  __R6__(avg_user_conversion_rate)__R6END__ AS avg_user_conversion_rate
FROM page_rates ORDER BY 1, 2""")


def _opportunity_values() -> str:
    from basketlens.sources.literals import OPPORTUNITY_MAP
    rows = []
    for i, (s, p, o, seg, lift) in enumerate(OPPORTUNITY_MAP):
        rows.append(f"({i}, {q([s])}, {q([p])}, {q([o])}, {q([seg])}, CAST({lift} AS DOUBLE))")
    return "opp(ordinal, strategy, page, opportunity, segment, projected_lift) AS (VALUES " + ", ".join(rows) + ")"


@oracle("opportunity_sizes")
def _opportunity_sizes():
    return with_adapter(PAGE_CONVERSION_CTES + ",\n" + _opportunity_values(), """
SELECT o.strategy, o.page, o.opportunity, o.segment, __R6__(t.avg_daily_users)__R6END__ AS avg_daily_users,
  __R6__(t.avg_user_conversion_rate)__R6END__ AS avg_conversion_rate, __R6__(o.projected_lift)__R6END__ AS projected_lift,
  __R6__(t.avg_user_conversion_rate * o.projected_lift)__R6END__ AS delta,
  __R6__(t.avg_daily_users * (t.avg_user_conversion_rate * o.projected_lift))__R6END__ AS new_conversions_daily,
  __R6__(t.avg_daily_users * (t.avg_user_conversion_rate * o.projected_lift) * 365.0)__R6END__ AS new_conversions_yearly,
  __R6__(t.avg_daily_users * (t.avg_user_conversion_rate * o.projected_lift) * 365.0 * 60.0)__R6END__ AS new_revenue_yearly
FROM opp o JOIN page_rates t ON t.event = o.page AND t.segment = o.segment
ORDER BY o.ordinal""")


# --- Q2: classified events of chosen customers ---------------------------------
EXPORT_EMAILS = f"SELECT DISTINCT lower(email) AS email FROM m_orders WHERE {VALID_ORDER} AND email IS NOT NULL"

DISTINCT_TO_EMAIL = """
order_links AS (SELECT distinct_id, json_extract_string(properties, '$.order_number') AS number FROM m_events),
distinct_to_email AS (
  SELECT DISTINCT l.distinct_id, lower(o.email) AS email FROM order_links l JOIN m_orders o USING (number) WHERE o.email IS NOT NULL)
"""


@oracle("classified_events")
def _classified_events():
    return with_adapter(DISTINCT_TO_EMAIL + f""",
attributed AS (
  SELECT m_events.* REPLACE (coalesce(lower(m_events.email), d.email) AS email)
  FROM m_events LEFT JOIN distinct_to_email d USING (distinct_id))
""", f"""SELECT email, if(trim(os) IN ({MOBILE}), 'mobile', 'desktop') AS platform, time, coalesce({path_case('name')}, '') AS name
FROM attributed SEMI JOIN ({EXPORT_EMAILS}) USING (email)
WHERE time BETWEEN {TS_START} AND {TS_END} AND name IN ({TRACKED})""")


# --- Q1: order facts (literal form: window row_number, EXISTS self-probe) -------
def _sale_case(col: str) -> str:
    return "CASE WHEN " + " OR ".join(f"{col} ILIKE '{p}'" for p in td.SALE_PATTERNS) + " THEN 1.0 ELSE 0.0 END"


ORDER_FACTS_CTES = f"""
placed AS (
  SELECT id AS order_id, lower(email) AS email, number AS order_number, completed_at AS order_completed_at, item_total, adjustment_total,
    if(user_id IS NULL, 1.0, 0.0)::DOUBLE AS is_guest,
    row_number() OVER (PARTITION BY lower(email) ORDER BY completed_at, id) AS order_index
  FROM m_orders WHERE {VALID_ORDER} AND email NOT LIKE '{td.STAFF_PATTERN}'),
catalogue AS (
  SELECT v.id AS variant_id, p.id AS product_id, {_sale_case('p.name')} AS on_sale
  FROM m_variants v JOIN m_products p ON p.id = v.product_id
  WHERE NOT v.is_deleted AND NOT p.is_deleted AND coalesce(p.name NOT IN ({NON_MERCH}), true)),
basket AS (
  SELECT order_id, variant_id, max(quantity) AS quantity, max(price) AS price, max(created_at) AS created_at
  FROM m_line_items WHERE NOT is_deleted GROUP BY ALL),
sold AS (
  SELECT b.*, c.product_id, c.on_sale, o.item_total,
    coalesce(o.order_index > min(o.order_index) OVER (PARTITION BY o.email, c.product_id), false) AND o.email IS NOT NULL AS bought_before
  FROM basket b JOIN catalogue c USING (variant_id) JOIN placed o USING (order_id)),
summed AS (
  SELECT order_id, min(created_at) AS min_line_item_created_at, max(created_at) AS max_line_item_created_at,
    sum(quantity)::DOUBLE AS units, count(DISTINCT product_id)::DOUBLE AS products, count(*)::DOUBLE AS line_items,
    max(on_sale)::DOUBLE AS has_sale_item, sum(on_sale * item_total)::DOUBLE AS sale_total,
    count(DISTINCT product_id) FILTER (bought_before)::DOUBLE AS common_products,
    coalesce(sum(quantity) FILTER (bought_before), 0)::DOUBLE AS common_units,
    coalesce(sum(price) FILTER (bought_before), 0)::DOUBLE AS common_total
  FROM sold GROUP BY order_id),
order_facts AS (
  SELECT summed.*, placed.* EXCLUDE (order_id) REPLACE (CAST(order_index AS DOUBLE) AS order_index, CAST(item_total AS DOUBLE) AS item_total, CAST(adjustment_total AS DOUBLE) AS adjustment_total),
    100.0 * (common_products / nullif(products, 0)) AS common_products_ratio,
    100.0 * (common_units / nullif(units, 0)) AS common_units_ratio,
    100.0 * (common_total / nullif(placed.item_total, 0)) AS common_total_ratio,
    CASE WHEN placed.order_index > 4 THEN '5+' WHEN placed.order_index > 1 THEN CAST(placed.order_index AS VARCHAR) END AS order_index_bucket,
    if(placed.order_index > 1, 1.0, 0.0)::DOUBLE AS is_repeat,
    100.0 * (greatest(-placed.adjustment_total, 0.0) / nullif(placed.item_total, 0)) AS discount_percentage,
    CAST(order_completed_at AS DATE) AS order_date, CAST(date_trunc('month', order_completed_at) AS DATE) AS order_month
  FROM summed JOIN placed USING (order_id))
"""

ORDER_FACT_DOUBLES = ["is_guest", "order_index", "units", "products", "line_items", "item_total",
                      "adjustment_total", "has_sale_item", "sale_total", "common_products", "common_units",
                      "common_total", "common_products_ratio", "common_units_ratio", "common_total_ratio",
                      "is_repeat", "discount_percentage"]


def rounded_select(cols_all: list[str], doubles: list[str], source: str) -> str:
    parts = [f"__R6__({c})__R6END__ AS {c}" if c in doubles else c for c in cols_all]
    return f"SELECT {', '.join(parts)} FROM {source}"


ORDER_FACT_COLUMNS = ["order_id", "email", "is_guest", "order_number", "order_index", "order_completed_at",
                      "min_line_item_created_at", "max_line_item_created_at", "units", "products", "line_items",
                      "item_total", "adjustment_total", "has_sale_item", "sale_total", "common_products",
                      "common_units", "common_total", "common_products_ratio", "common_units_ratio",
                      "common_total_ratio", "order_index_bucket", "is_repeat", "discount_percentage",
                      "order_date", "order_month"]


@oracle("order_facts")
def _order_facts():
    return with_adapter(ORDER_FACTS_CTES, rounded_select(ORDER_FACT_COLUMNS, ORDER_FACT_DOUBLES, "order_facts"))


# --- Q3: visit stats (orders by place in their spelling's sequence, visits by the previous day) -----------
VISIT_STATS_CTES = DISTINCT_TO_EMAIL + """,
purchases AS (
  SELECT lower(email) AS email, completed_at, row_number() OVER (PARTITION BY email ORDER BY completed_at, id) AS place
  FROM m_orders WHERE environment = 0 AND completed_at IS NOT NULL),
order_gaps AS (
  SELECT email, date_diff('day', earlier.completed_at, later.completed_at) AS days
  FROM (SELECT email, place + 1 AS place, completed_at FROM purchases) earlier JOIN purchases later USING (email, place)),
visits AS (
  SELECT coalesce(lower(m_events.email), d.email) AS email, time, date_trunc('day', time) AS day
  FROM m_events LEFT JOIN distinct_to_email d USING (distinct_id)),
day_gaps AS (
  SELECT email, date_diff('day', lag(day) OVER (PARTITION BY email ORDER BY day), day) AS days
  FROM (SELECT DISTINCT email, day FROM visits)),
spans AS (
  SELECT email, min(time) AS min_visit_time, max(time) AS max_visit_time, count(DISTINCT day) AS visit_days,
    date_diff('day', min(time), max(time)) AS days_retained
  FROM visits GROUP BY email),
vs AS (
  SELECT s.*, CAST(days_retained AS DOUBLE) / visit_days AS days_retained_per_visit, o.* EXCLUDE (email), v.* EXCLUDE (email)
  FROM spans s
    LEFT JOIN (SELECT email, avg(days) AS avg_days_between_orders, min(days) AS min_days_between_orders, max(days) AS max_days_between_orders
               FROM order_gaps GROUP BY email) o ON o.email = s.email
    LEFT JOIN (SELECT email, avg(days) AS avg_days_between_visits, min(days) AS min_days_between_visits, max(days) AS max_days_between_visits
               FROM day_gaps GROUP BY email) v ON v.email = s.email)
"""


@oracle("visit_stats")
def _visit_stats():
    return with_adapter(VISIT_STATS_CTES, """
SELECT email, min_visit_time, max_visit_time, visit_days, days_retained,
  __R6__(days_retained_per_visit)__R6END__ AS days_retained_per_visit,
  __R6__(avg_days_between_orders)__R6END__ AS avg_days_between_orders, min_days_between_orders, max_days_between_orders,
  __R6__(avg_days_between_visits)__R6END__ AS avg_days_between_visits, min_days_between_visits, max_days_between_visits
FROM vs""")


# --- Q4: first-order divisions (the earliest order with a sellable line, then its lines) -------
FIRST_ORDER_CTES = f"""
merchandise AS (SELECT * FROM m_products WHERE NOT is_deleted AND coalesce(name NOT IN ({NON_MERCH}), true)),
shop_orders AS (SELECT id, lower(email) AS email, completed_at FROM m_orders WHERE state = 'complete' AND environment = 0 AND NOT is_deleted),
opening AS (
  SELECT id, email FROM shop_orders
  WHERE id IN (SELECT li.order_id FROM m_line_items li JOIN m_variants v ON v.id = li.variant_id JOIN merchandise p ON p.id = v.product_id
               WHERE NOT li.is_deleted AND NOT v.is_deleted)
  QUALIFY row_number() OVER (PARTITION BY email ORDER BY completed_at NULLS LAST, id) = 1),
opening_lines AS (
  SELECT o.email, v.sku, v.product_id
  FROM opening o JOIN m_line_items li ON li.order_id = o.id AND NOT li.is_deleted
    LEFT JOIN (SELECT * FROM m_variants WHERE NOT is_deleted) v ON v.id = li.variant_id),
fod AS (
  SELECT email, coalesce(string_agg(DISTINCT division, '|' ORDER BY division), '') AS first_order_division
  FROM opening_lines l LEFT JOIN m_product_map pm ON pm.style_code = left(l.sku, 6)
  WHERE NOT EXISTS (SELECT 1 FROM m_products p WHERE p.id = l.product_id AND NOT p.is_deleted AND p.name IN ({NON_MERCH}))
  GROUP BY email)
"""


@oracle("first_order_divisions")
def _first_order_divisions():
    return with_adapter(FIRST_ORDER_CTES, "SELECT * FROM fod ORDER BY email NULLS LAST")


@oracle("variant_facts")
def _variant_facts():
    return with_adapter("", """
SELECT variant_id,
  coalesce(string_agg(name, ' | ' ORDER BY name) FILTER (option_type_id = 9), '') AS size,
  coalesce(string_agg(name, ' | ' ORDER BY name) FILTER (option_type_id = 2), '') AS color
FROM (SELECT * FROM m_option_values_variants WHERE NOT is_deleted) a
  LEFT JOIN (SELECT id AS option_value_id, option_type_id, name FROM m_option_values WHERE NOT is_deleted) o USING (option_value_id)
GROUP BY variant_id""")


# --- Q5: customer facts ----------------------------------------------------------------
def _list_emails(where: str) -> str:
    raw = f"concat(' Cust', CAST(c_custkey AS VARCHAR), '@', {_dom('c_custkey')}, ' ')"
    return f"SELECT DISTINCT lower(trim({raw})) AS email FROM customer WHERE {where}"


def _cut(col: str, edges, labels, open_top: bool) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo = edges[i]
        hi = None if (open_top and i == len(labels) - 1) else edges[i + 1]
        cond = f"{col} >= {lo}" + (f" AND {col} < {hi}" if hi is not None else "")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _customer_ctes() -> str:
    from basketlens.functions import buckets as B
    probs = ", ".join(f"{i / 10}" for i in range(11))
    return VISIT_STATS_CTES + ",\n" + FIRST_ORDER_CTES + f""",
cf_export AS (
  SELECT lower(o.email) AS email, CAST(CAST(min(o.completed_at) AS DATE) AS TIMESTAMP) AS first_order_date,
    floor(CAST(sum(CAST(round(r.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 300000.0 * 100.0 + 0.5) / 100.0
      AS lifetime_gpr, CAST(count(o.id) AS DOUBLE) AS lifetime_orders,
    CAST(coalesce(sum(u.units), 0) AS DOUBLE) AS lifetime_units
  FROM m_orders o
    JOIN orders r ON r.o_orderkey = o.id
    LEFT JOIN (SELECT order_id, sum(quantity) AS units FROM m_line_items WHERE is_deleted = false GROUP BY 1) u
      ON o.id = u.order_id
  WHERE o.is_deleted = false AND o.state = 'complete' AND o.environment = 0 AND o.completed_at IS NOT NULL
    AND o.email IS NOT NULL
  GROUP BY 1),
cf_joined AS (
  SELECT e.*, vs.min_visit_time, vs.max_visit_time, vs.visit_days,
    CASE WHEN vs.days_retained < 1 THEN 1.0 ELSE CAST(vs.days_retained AS DOUBLE) END AS days_retained,
    CASE WHEN vs.days_retained_per_visit < 1 THEN 1.0 ELSE vs.days_retained_per_visit END AS days_retained_per_visit,
    vs.avg_days_between_orders, vs.min_days_between_orders, vs.max_days_between_orders,
    vs.avg_days_between_visits, vs.min_days_between_visits, vs.max_days_between_visits
  FROM cf_export e LEFT JOIN vs ON vs.email = e.email),
cf_ret AS (
  SELECT *,
    CASE WHEN days_retained >= 90.0 THEN days_retained / 90.0 ELSE 1.0 END AS quarters_retained,
    lifetime_orders / (CASE WHEN days_retained >= 90.0 THEN days_retained / 90.0 ELSE 1.0 END) AS orders_per_quarter,
    CASE WHEN days_retained >= 365.0 THEN days_retained / 365.0 ELSE 1.0 END AS years_retained,
    lifetime_orders / (CASE WHEN days_retained >= 365.0 THEN days_retained / 365.0 ELSE 1.0 END) AS orders_per_year
  FROM cf_joined),
cf_fod AS (
  SELECT email, regexp_replace(first_order_division, '\\|unknown', '', 'g') AS first_order_division
  FROM fod),
cf_div AS (
  SELECT r.*, f.first_order_division,
    CASE WHEN f.email IS NULL THEN NULL
         WHEN f.first_order_division IN ('baby', 'baby|kids') THEN 1.0 ELSE 0.0 END AS first_order_has_baby,
    CASE WHEN f.email IS NULL THEN NULL
         WHEN f.first_order_division IN ('kids', 'baby|kids') THEN 1.0 ELSE 0.0 END AS first_order_has_kids
  FROM cf_ret r LEFT JOIN cf_fod f ON f.email = r.email),
cf_lists AS (
  SELECT d.*,
    CASE WHEN d.email IN ({_list_emails("c_mktsegment = 'BUILDING'")}) THEN 1.0 ELSE 0.0 END AS is_picks_buyer,
    CASE WHEN d.email IN ({_list_emails("c_acctbal > 5000")}) THEN 1.0 ELSE 0.0 END AS is_picks_waitlist,
    CASE WHEN d.email IN ({_list_emails("c_nationkey % 5 = 0")}) THEN 1.0 ELSE 0.0 END AS is_marketing_opt_out
  FROM cf_div d),
cf_freq AS (
  SELECT *, days_retained * 1.0 / nullif(lifetime_orders, 0) AS order_frequency,
    CAST(date_trunc('month', first_order_date) AS TIMESTAMP) AS first_order_month,
    lifetime_gpr / nullif(lifetime_orders, 0) AS lifetime_aov
  FROM cf_lists),
cf_edges AS (
  SELECT list_sort(list_distinct(list_transform(quantile_cont(lifetime_orders, [{probs}]), lambda x: round(x, 9))))
    AS edges
  FROM cf_freq),
customer_facts AS (
  SELECT f.*,
    CASE WHEN f.lifetime_orders IS NULL THEN NULL
         ELSE greatest(len(list_filter(c.edges, lambda e: e < f.lifetime_orders)) - 1, 0) END AS lifetime_orders_decile,
    {_cut('f.lifetime_orders', B.LIFETIME_ORDERS_EDGES, B.LIFETIME_ORDERS_LABELS, True)} AS lifetime_orders_bucket,
    {_cut('f.lifetime_aov', B.AOV_EDGES, B.AOV_LABELS, True)} AS lifetime_aov_bucket,
    {_cut('f.orders_per_quarter', B.ORDERS_PER_QUARTER_EDGES, B.ORDERS_PER_QUARTER_LABELS, True)}
      AS orders_per_quarter_bucket
  FROM cf_freq f CROSS JOIN cf_edges c)
"""


CUSTOMER_COLUMNS = {
    "email": "str", "first_order_date": "ts", "lifetime_gpr": "d", "lifetime_orders": "d", "lifetime_units": "d",
    "min_visit_time": "ts", "max_visit_time": "ts", "visit_days": "i", "days_retained": "d",
    "days_retained_per_visit": "d", "avg_days_between_orders": "d", "min_days_between_orders": "d",
    "max_days_between_orders": "d", "avg_days_between_visits": "d", "min_days_between_visits": "d",
    "max_days_between_visits": "d", "quarters_retained": "d", "orders_per_quarter": "d", "years_retained": "d",
    "orders_per_year": "d", "first_order_division": "s", "first_order_has_baby": "d",
    "first_order_has_kids": "d", "is_picks_buyer": "d", "is_picks_waitlist": "d", "is_marketing_opt_out": "d",
    "order_frequency": "d", "first_order_month": "ts", "lifetime_aov": "d", "lifetime_orders_decile": "i",
    "lifetime_orders_bucket": "s", "lifetime_aov_bucket": "s", "orders_per_quarter_bucket": "s",
}


def customer_select(source: str = "customer_facts", rounding: bool = True) -> str:
    parts = []
    for c, k in CUSTOMER_COLUMNS.items():
        if k == "d" and not rounding:
            parts.append(c)
        elif k == "d":
            parts.append(f"__R6__({c})__R6END__ AS {c}")
        elif k == "i":
            parts.append(f"CAST({c} AS BIGINT) AS {c}")
        elif k == "str":
            parts.append(f"coalesce({c}, '') AS {c}")
        else:
            parts.append(c)
    return f"SELECT {', '.join(parts)} FROM {source}"


@oracle("customer_facts")
def _customer_facts():
    return with_adapter(_customer_ctes(), customer_select())


# --- Reports over the customer and order tables ------------------------------------------
USERS_CTES = _customer_ctes() + ",\nusers AS (" + customer_select(rounding=False) + ")"
TX_CTES = ORDER_FACTS_CTES + ",\ntx AS (" + rounded_select(ORDER_FACT_COLUMNS, [], "order_facts") + ")"
CANDIDATES = ("(SELECT * FROM users WHERE lifetime_orders > 1 AND avg_days_between_orders IS NOT NULL"
              " AND avg_days_between_visits IS NOT NULL)")


def _r(expr: str) -> str:
    return f"__R6__({expr})__R6END__"


def hist_sql(source: str, col: str, by: list[str] | None = None, max_bins: int = 50, p: str = "h") -> tuple[str, str]:
    """CTEs + final select of an automatic-bin histogram (numpy's equal-width
    rule with its edge corrections, Freedman-Diaconis bin count)."""
    by = by or []
    b = "".join(f"{c}, " for c in by)
    g = ("GROUP BY " + ", ".join(by)) if by else ""
    on = " AND ".join(f"d.{c} = s.{c}" for c in by) or "TRUE"
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    ctes = f"""
{p}_base AS (SELECT {b}CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
{p}_stats AS (
  SELECT {b}count(x) AS n, min(x) AS lo0, max(x) AS hi0,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr
  FROM {p}_base {g}),
{p}_b AS (
  SELECT {b}least(CASE WHEN n < 2 THEN 1
      WHEN 2.0 * iqr / pow(CAST(n AS DOUBLE), CAST(1.0 AS DOUBLE) / 3.0) = 0 THEN CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT)
      ELSE CAST(ceil((hi0 - lo0) / (2.0 * iqr / pow(CAST(n AS DOUBLE), CAST(1.0 AS DOUBLE) / 3.0))) AS BIGINT) END,
      {max_bins}) AS bins,
    CASE WHEN hi0 = lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
    CASE WHEN hi0 = lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi
  FROM {p}_stats),
{p}_i0 AS (
  SELECT {''.join(f'd.{c}, ' for c in by)}d.x, s.lo, s.hi, s.bins,
    CASE WHEN floor((d.x - s.lo) * (s.bins / (s.hi - s.lo))) = s.bins THEN s.bins - 1
         ELSE floor((d.x - s.lo) * (s.bins / (s.hi - s.lo))) END AS i0
  FROM {p}_base d JOIN {p}_b s ON {on}),
{p}_i1 AS (
  SELECT *, CASE WHEN x < (CASE WHEN i0 = bins THEN hi ELSE lo + i0 * ((hi - lo) / bins) END) THEN i0 - 1
                 ELSE i0 END AS i1
  FROM {p}_i0),
{p}_i2 AS (
  SELECT {b}CAST(CASE WHEN x >= (CASE WHEN i1 + 1 = bins THEN hi ELSE lo + (i1 + 1) * ((hi - lo) / bins) END)
                      AND i1 != bins - 1 THEN i1 + 1 ELSE i1 END AS BIGINT) AS bin
  FROM {p}_i1),
{p}_counts AS (SELECT {b}bin, count(*) AS cnt FROM {p}_i2 GROUP BY {b}bin),
{p}_all AS (
  SELECT {b}bin, lo + bin * ((hi - lo) / bins) AS bin_lo,
    CASE WHEN bin = bins - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / bins) END AS bin_hi
  FROM (SELECT *, unnest(generate_series(0, bins - 1)) AS bin FROM {p}_b)),
{p}_dense AS (
  SELECT {''.join(f'a.{c}, ' for c in by)}a.bin, a.bin_lo, a.bin_hi, coalesce(c.cnt, 0) AS count
  FROM {p}_all a LEFT JOIN {p}_counts c ON a.bin = c.bin {''.join(f' AND a.{c} = c.{c}' for c in by)})
"""
    final = f"""SELECT {b}bin, {_r('bin_lo')} AS bin_lo, {_r('bin_hi')} AS bin_hi, CAST(count AS BIGINT) AS count,
  {_r(f'CAST(sum(count) OVER ({part} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)'
      f' / nullif(sum(count) OVER ({part}), 0)')} AS cumulative_fraction
FROM {p}_dense"""
    return ctes, final


def edges_hist_sql(source: str, col: str, edges) -> tuple[str, str]:
    nb = len(edges) - 1
    case = "CASE " + " ".join(
        f"WHEN x >= {float(edges[i])}" + ("" if i == nb - 1 else f" AND x < {float(edges[i + 1])}") + f" THEN {i}"
        for i in range(nb)) + " END"
    vals = ", ".join(f"({i}, {float(edges[i])}, {float(edges[i + 1])})" for i in range(nb))
    ctes = f"""
e_base AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
e_counts AS (SELECT CAST({case} AS BIGINT) AS bin, count(*) AS cnt FROM e_base GROUP BY 1),
e_bins(bin, bin_lo, bin_hi) AS (VALUES {vals}),
e_dense AS (SELECT CAST(b.bin AS BIGINT) AS bin, CAST(b.bin_lo AS DOUBLE) AS bin_lo, CAST(b.bin_hi AS DOUBLE) AS bin_hi,
  coalesce(c.cnt, 0) AS count FROM e_bins b LEFT JOIN e_counts c ON b.bin = c.bin)
"""
    final = f"""SELECT bin, {_r('bin_lo')} AS bin_lo, {_r('bin_hi')} AS bin_hi, CAST(count AS BIGINT) AS count,
  {_r('CAST(sum(count) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif((SELECT count(*) FROM e_base), 0)')}
    AS cumulative_fraction
FROM e_dense"""
    return ctes, final


def mean_by_sql(source: str, x: str, y: str, keys: list[str]) -> str:
    g = [x, *keys]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in [*g, y])
    return f"""SELECT {', '.join(g)}, {_r('m')} AS mean, n, {_r('s')} AS std,
  {_r(f'm - {Z95} * s / sqrt(n)')} AS ci_low, {_r(f'm + {Z95} * s / sqrt(n)')} AS ci_high
FROM (SELECT {', '.join(g)}, avg({y}) AS m, count({y}) AS n, stddev_samp({y}) AS s
      FROM {source} WHERE {notnull} GROUP BY {', '.join(g)})"""


def labels_sql(name: str, labels) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({q([l])}, {i})' for i, l in enumerate(labels))}) t({name}, {name}_ord))"


def grid_sql(source: str, row: str, col: str, row_labels, col_labels, agg: str, value: str | None) -> str:
    """Dense grid (row, col, value) for agg in sum/count/mean/share."""
    if agg == "sum":
        a, v = f"sum({value}) AS a", "CAST(coalesce(g.a, 0) AS BIGINT)"
    elif agg == "count":
        a, v = "count(*) AS a", "CAST(coalesce(g.a, 0) AS BIGINT)"
    elif agg == "mean":
        a, v = f"avg({value}) AS a", "coalesce(g.a, 0.0)"
    else:
        a, v = f"sum({value}) AS a, count(*) AS c", "coalesce(g.a, 0.0) / nullif(coalesce(g.c, 0), 0)"
    return f"""SELECT r.{row}, c.{col}, {v} AS value
FROM {labels_sql(row, row_labels)} r CROSS JOIN {labels_sql(col, col_labels)} c
  LEFT JOIN (SELECT {row}, {col}, {a} FROM {source} WHERE {row} IS NOT NULL AND {col} IS NOT NULL
             GROUP BY 1, 2) g ON g.{row} = r.{row} AND g.{col} = c.{col}"""


def _users_report(name: str, body_ctes: str, final: str):
    ORACLE[name] = expand_rounding(with_adapter(USERS_CTES + ("," + body_ctes if body_ctes.strip() else ""),
                                                final))


def _tx_report(name: str, body_ctes: str, final: str):
    ORACLE[name] = expand_rounding(with_adapter(TX_CTES + ("," + body_ctes if body_ctes.strip() else ""), final))


def _register_report_oracles():
    from basketlens.functions import buckets as B
    from basketlens.plans.reports import LIFETIME_CDF_EDGES

    probs = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    qs = ", ".join(f"{_r(f'quantile_cont(orders_per_year, {p})')} AS p{round(p * 100)}" for p in probs)
    _users_report("orders_per_year_summary", "", f"""
SELECT count(orders_per_year) AS count, {_r('avg(orders_per_year)')} AS mean,
  {_r('stddev_samp(orders_per_year)')} AS std, {_r('min(orders_per_year)')} AS min, {qs},
  {_r('max(orders_per_year)')} AS max
FROM users WHERE orders_per_year IS NOT NULL""")

    for name, src, col, by in [
            ("orders_per_year_histogram", "users", "orders_per_year", None),
            ("lifetime_orders_histogram", "users", "lifetime_orders", None),
            ("lifetime_orders_histogram_repeat", CANDIDATES, "lifetime_orders", None)]:
        c, f = hist_sql(src, col, by)
        _users_report(name, c, f)
    melted = (f"(SELECT 'orders' AS variable, avg_days_between_orders AS value FROM {CANDIDATES} "
              f"UNION ALL SELECT 'visits', avg_days_between_visits FROM {CANDIDATES})")
    c, f = hist_sql(melted, "value", ["variable"])
    _users_report("gap_distributions", c, f)
    c, f = edges_hist_sql("users", "lifetime_orders", LIFETIME_CDF_EDGES)
    _users_report("lifetime_orders_cdf", c, f)

    pl = ", ".join(str(i / 100.0) for i in range(1, 51))
    _users_report("subscription_percentiles", f"""
s_sorted AS (SELECT orders_per_year, greatest(0.0, 4.0 - floor(orders_per_year)) AS new_orders
             FROM users WHERE orders_per_year IS NOT NULL),
s_run AS (
  SELECT sum(new_orders) OVER w * 68.0 AS rev, sum(new_orders) OVER w * 23.10 AS prof,
    CAST(count(*) OVER w AS DOUBLE) AS us
  FROM s_sorted WINDOW w AS (ORDER BY orders_per_year DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s_q AS (SELECT quantile_cont(rev, [{pl}]) AS rv, quantile_cont(prof, [{pl}]) AS pf, quantile_cont(us, [{pl}]) AS uq
        FROM s_run)
""", f"""SELECT CAST(i AS INTEGER) AS coverage_percentage, {_r('rv[i]')} AS cumulative_new_revenue,
  {_r('pf[i]')} AS cumulative_new_profit, {_r('uq[i]')} AS cumulative_users
FROM s_q, range(1, 51) t(i)""")
    _users_report("subscription_curve", """
s_g AS (SELECT greatest(0.0, 4.0 - floor(orders_per_year)) AS new_orders, count(*) AS n
        FROM users WHERE orders_per_year IS NOT NULL GROUP BY 1)
""", f"""SELECT new_orders, n,
  CAST(sum(n) OVER (ORDER BY new_orders ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_users,
  {_r('sum(new_orders * n) OVER (ORDER BY new_orders ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 68.0')}
    AS cumulative_new_revenue,
  {_r('sum(new_orders * n) OVER (ORDER BY new_orders ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 23.10')}
    AS cumulative_new_profit
FROM s_g""")
    _users_report("subscription_running_totals", "", f"""
SELECT email, {_r('orders_per_year')} AS orders_per_year, greatest(0.0, 4.0 - floor(orders_per_year)) AS new_orders,
  count(*) OVER w AS cumulative_users,
  {_r('sum(greatest(0.0, 4.0 - floor(orders_per_year))) OVER w * 68.0')} AS cumulative_new_revenue,
  {_r('sum(greatest(0.0, 4.0 - floor(orders_per_year))) OVER w * 23.10')} AS cumulative_new_profit
FROM users WHERE orders_per_year IS NOT NULL
WINDOW w AS (ORDER BY orders_per_year DESC, email NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    _users_report("acquisition_by_month", "", """
SELECT first_order_month, count(*) AS users FROM users WHERE first_order_month IS NOT NULL GROUP BY 1""")
    _users_report("users_by_division", "", f"""
SELECT first_order_division, count(*) AS users FROM {CANDIDATES} c WHERE first_order_division IS NOT NULL GROUP BY 1""")
    _users_report("division_counts", "", """
SELECT coalesce(first_order_division, 'na') AS first_order_division, count(*) AS users FROM users GROUP BY 1""")
    melted3 = (f"(SELECT lifetime_orders, first_order_division, 'orders' AS variable, avg_days_between_orders AS value "
               f"FROM {CANDIDATES} UNION ALL SELECT lifetime_orders, first_order_division, 'visits', "
               f"avg_days_between_visits FROM {CANDIDATES})")
    _users_report("gap_by_lifetime_orders", "", mean_by_sql(melted3, "lifetime_orders", "value", ["variable"]))
    _users_report("gap_by_lifetime_orders_division", "", mean_by_sql(
        f"(SELECT * FROM {melted3} WHERE first_order_division != 'unknown')", "lifetime_orders", "value",
        ["variable", "first_order_division"]))
    _users_report("quality_onetimers", """
qo AS (SELECT * FROM users WHERE lifetime_orders < 2 AND lifetime_gpr > 90.0)
""", f"""SELECT CAST(month(first_order_month) AS INTEGER) AS month, count(email) AS users,
  {_r('count(email) / (SELECT count(*) FROM qo) * 100.0')} AS percentage
FROM qo WHERE first_order_month IS NOT NULL GROUP BY 1""")

    def grids(parts):
        sels = []
        for gname, row, row_labels, value, agg in parts:
            sels.append(f"SELECT '{gname}' AS grid, {row} AS row_bucket, lifetime_aov_bucket AS col_bucket, "
                        f"{_r('CAST(value AS DOUBLE)')} AS value FROM ("
                        + grid_sql("users", row, "lifetime_aov_bucket", row_labels, B.AOV_LABELS, agg, value) + ")")
        return "\nUNION ALL\n".join(sels)
    LO = ("lifetime_orders_bucket", B.LIFETIME_ORDERS_LABELS)
    OQ = ("orders_per_quarter_bucket", B.ORDERS_PER_QUARTER_LABELS)
    for name, flag in [("picks_buyer_grids", "is_picks_buyer"), ("waitlist_grids", "is_picks_waitlist")]:
        _users_report(name, "", grids([("lifetime_orders", *LO, flag, "sum"), ("orders_per_quarter", *OQ, flag, "sum")]))
    f = "is_marketing_opt_out"
    _users_report("opt_out_grids", "", grids([("lifetime_orders", *LO, f, "sum"),
                                              ("lifetime_orders_share", *LO, f, "share"),
                                              ("orders_per_quarter", *OQ, f, "sum")]))
    flags = ("is_picks_buyer", "is_picks_waitlist", f)
    _users_report("customer_grids", "", grids([
        ("customers", *LO, None, "count"), ("customers_per_quarter", *OQ, None, "count"),
        *[(x, *LO, x, "sum") for x in flags], *[(f"{x}_per_quarter", *OQ, x, "sum") for x in flags],
        ("opt_out_share", *LO, f, "share"), ("kids_rate", *LO, "first_order_has_kids", "mean")]))
    kg = grid_sql("users", "lifetime_orders_bucket", "lifetime_aov_bucket", B.LIFETIME_ORDERS_LABELS, B.AOV_LABELS,
                  "mean", "first_order_has_kids")
    _users_report("kids_rate_grid", "", f"SELECT lifetime_orders_bucket, lifetime_aov_bucket, {_r('value')} AS value "
                                        f"FROM ({kg})")
    _users_report("top_customers", "", f"""
SELECT email, {_r('lifetime_orders')} AS lifetime_orders,
  CAST(row_number() OVER (ORDER BY lifetime_orders DESC, email) AS INTEGER) AS user_index
FROM users ORDER BY lifetime_orders DESC, email LIMIT 10""")
    a, b = td.TENURE_WINDOW
    _users_report("middle_customers", f"""
mc AS (SELECT email, lifetime_orders, row_number() OVER (ORDER BY lifetime_orders DESC, email) AS pos
       FROM users WHERE lifetime_orders > 1 AND min_visit_time < TIMESTAMP '{a} 00:00:00'
         AND max_visit_time > TIMESTAMP '{b} 00:00:00'),
mc_mid AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS mid FROM mc)
""", f"""SELECT email, {_r('lifetime_orders')} AS lifetime_orders, CAST(pos - mid AS BIGINT) AS user_index
FROM mc, mc_mid WHERE pos > mid AND pos <= mid + 10""")
    _users_report("customer_export_max", "", f"""
SELECT email, max(first_order_date) AS first_order_date, {_r('max(lifetime_gpr)')} AS lifetime_gpr,
  {_r('max(lifetime_orders)')} AS lifetime_orders, {_r('max(lifetime_units)')} AS lifetime_units
FROM cf_export GROUP BY 1""")
    cls = "CASE " + " ".join(f"WHEN i.name = '{k}' THEN '{v}'" for k, v in PATH_NAMES.items()) + " ELSE i.name END"
    _users_report("user_paths_top", f"""
top AS (SELECT email, CAST(row_number() OVER (ORDER BY lifetime_orders DESC, email) AS INTEGER) AS user_index
        FROM (SELECT * FROM users ORDER BY lifetime_orders DESC, email LIMIT 10)),
up_ev AS (
  SELECT coalesce(lower(e.email), dte.email) AS email,
    CASE WHEN trim(e.os) IN ({MOBILE}) THEN 'mobile' ELSE 'desktop' END AS platform, e.time AS time, e.name
  FROM m_events e LEFT JOIN distinct_to_email dte ON dte.distinct_id = e.distinct_id
  WHERE e.time BETWEEN {TS_START} AND {TS_END} AND e.name IN ({TRACKED}))
""", f"""SELECT t.user_index, i.email, i.time, {_r('epoch_us(i.time) / 1000000.0')} AS epoch, {cls} AS name, i.platform
FROM up_ev i JOIN top t ON t.email = i.email
WHERE i.email IS NOT NULL AND ({cls}) IN ('pdp', 'add_to_bag', 'checkout')""")

    _users_report("user_paths_top_visitors", f"""
top AS (SELECT email, CAST(row_number() OVER (ORDER BY lifetime_orders DESC, email) AS INTEGER) AS user_index
        FROM (SELECT * FROM users WHERE min_visit_time IS NOT NULL ORDER BY lifetime_orders DESC, email LIMIT 10)),
up_ev AS (
  SELECT coalesce(lower(e.email), dte.email) AS email,
    CASE WHEN trim(e.os) IN ({MOBILE}) THEN 'mobile' ELSE 'desktop' END AS platform, e.time AS time, e.name
  FROM m_events e LEFT JOIN distinct_to_email dte ON dte.distinct_id = e.distinct_id
  WHERE e.time BETWEEN {TS_START} AND {TS_END} AND e.name IN ({TRACKED}))
""", f"""SELECT t.user_index, i.email, i.time, {_r('epoch_us(i.time) / 1000000.0')} AS epoch, {cls} AS name, i.platform
FROM up_ev i JOIN top t ON t.email = i.email
WHERE i.email IS NOT NULL AND ({cls}) IN ('pdp', 'add_to_bag', 'checkout')""")

    _users_report("user_paths_middle", f"""
mc AS (SELECT email, lifetime_orders, row_number() OVER (ORDER BY lifetime_orders DESC, email) AS pos
       FROM users WHERE lifetime_orders > 1 AND min_visit_time < TIMESTAMP '{a} 00:00:00'
         AND max_visit_time > TIMESTAMP '{b} 00:00:00'),
mc_mid AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS mid FROM mc),
top AS (SELECT email, CAST(pos - mid AS BIGINT) AS user_index FROM mc, mc_mid WHERE pos > mid AND pos <= mid + 10),
up_ev AS (
  SELECT coalesce(lower(e.email), dte.email) AS email,
    CASE WHEN trim(e.os) IN ({MOBILE}) THEN 'mobile' ELSE 'desktop' END AS platform, e.time AS time, e.name
  FROM m_events e LEFT JOIN distinct_to_email dte ON dte.distinct_id = e.distinct_id
  WHERE e.time BETWEEN {TS_START} AND {TS_END} AND e.name IN ({TRACKED}))
""", f"""SELECT t.user_index, i.email, i.time, {_r('epoch_us(i.time) / 1000000.0')} AS epoch, {cls} AS name, i.platform
FROM up_ev i JOIN top t ON t.email = i.email
WHERE i.email IS NOT NULL AND ({cls}) IN ('pdp', 'add_to_bag', 'checkout')""")

    cols = ", ".join(c if k != "d" else f"{_r(c)} AS {c}" for c, k in CUSTOMER_COLUMNS.items())
    _users_report("nth_multi_order_customer", """
nth AS (SELECT *, row_number() OVER (ORDER BY email) AS pos FROM users WHERE lifetime_orders > 1)
""", f"SELECT {cols} FROM nth WHERE pos = 101")

    # order-table reports
    rb = "CASE " + " ".join(f"WHEN common_products_ratio >= {B.RATIO_EDGES[i]} AND common_products_ratio < "
                            f"{B.RATIO_EDGES[i + 1]} THEN '{lab}'" for i, lab in enumerate(B.RATIO_LABELS)) + " END"
    ob = ("CASE WHEN order_index >= 2 AND order_index < 3 THEN '2' WHEN order_index >= 3 AND order_index < 4 THEN '3' "
          "WHEN order_index >= 4 AND order_index < 5 THEN '4' WHEN order_index >= 5 THEN '5+' END")
    _tx_report("repeat_product_mix", f"""
rp AS (SELECT {ob} AS order_number, {rb} AS product_ratio_bucket FROM tx WHERE order_index > 1.0),
rp_grid AS ({grid_sql('rp', 'order_number', 'product_ratio_bucket', B.ORDER_INDEX_LABELS, B.RATIO_LABELS, 'count', None)}),
rp_tot AS (SELECT l.order_number, CAST(coalesce(c.n, 0) AS BIGINT) AS order_number_total
           FROM {labels_sql('order_number', B.ORDER_INDEX_LABELS)} l
             LEFT JOIN (SELECT order_number, count(*) AS n FROM rp WHERE order_number IS NOT NULL GROUP BY 1) c
               ON c.order_number = l.order_number)
""", f"""SELECT g.order_number, g.product_ratio_bucket, g.value AS transactions, t.order_number_total,
  {_r('g.value / nullif(t.order_number_total, 0) * 100.0')} AS percentage
FROM rp_grid g JOIN rp_tot t ON g.order_number = t.order_number""")

    def cust(flag_expr, flag_name):
        return f"""(SELECT *, {_cut('orders', B.LIFETIME_ORDERS_EDGES, B.LIFETIME_ORDERS_LABELS, True)} AS order_count_bucket,
  {_cut('aov', B.AOV_EDGES, B.AOV_LABELS, True)} AS aov_bucket
FROM (SELECT email, {flag_expr} AS {flag_name}, count(order_id) AS orders, avg(item_total) AS aov FROM tx GROUP BY email))"""
    _tx_report("guest_order_mix", f"""
gu AS {cust('max(is_guest)', 'is_guest')},
gm_cells AS (SELECT l.*, g.is_guest FROM {labels_sql('order_count_bucket', B.LIFETIME_ORDERS_LABELS)} l
             CROSS JOIN (SELECT DISTINCT is_guest FROM gu WHERE is_guest IS NOT NULL) g),
gm_counts AS (SELECT order_count_bucket, is_guest, count(*) AS n FROM gu
              WHERE order_count_bucket IS NOT NULL AND is_guest IS NOT NULL GROUP BY 1, 2),
gm_group AS (SELECT is_guest, count(*) AS is_guest_transactions FROM gu GROUP BY 1)
""", f"""SELECT c.order_count_bucket, {_r('c.is_guest')} AS is_guest, CAST(coalesce(n.n, 0) AS BIGINT) AS transactions,
  g.is_guest_transactions, {_r('coalesce(n.n, 0) / nullif(g.is_guest_transactions, 0) * 100.0')} AS percentage
FROM gm_cells c LEFT JOIN gm_counts n ON n.order_count_bucket = c.order_count_bucket AND n.is_guest = c.is_guest
  LEFT JOIN gm_group g ON g.is_guest = c.is_guest""")
    _tx_report("guest_penetration_grid", f"""
gu AS {cust('max(is_guest)', 'is_guest')},
gp AS (SELECT aov_bucket, order_count_bucket, count(*) AS users, count(*) FILTER (WHERE is_guest > 0.0) AS guest_users
       FROM gu WHERE aov_bucket IS NOT NULL AND order_count_bucket IS NOT NULL GROUP BY 1, 2)
""", f"""SELECT a.aov_bucket, o.order_count_bucket, CAST(coalesce(g.users, 0) AS BIGINT) AS users,
  CAST(coalesce(g.guest_users, 0) AS BIGINT) AS guest_users,
  {_r('CAST(coalesce(g.guest_users, 0) AS DOUBLE) / nullif(coalesce(g.users, 0), 0)')} AS guest_percentage
FROM {labels_sql('aov_bucket', B.AOV_LABELS)} a CROSS JOIN {labels_sql('order_count_bucket', B.LIFETIME_ORDERS_LABELS)} o
  LEFT JOIN gp g ON g.aov_bucket = a.aov_bucket AND g.order_count_bucket = o.order_count_bucket""")
    _tx_report("sale_orders_by_month", "", """
SELECT order_month, count(*) AS orders FROM tx WHERE has_sale_item > 0 AND order_month IS NOT NULL GROUP BY 1""")
    _tx_report("sale_orders_grid", f"su AS {cust('sum(has_sale_item)', 'sale_orders')}",
               grid_sql("su", "order_count_bucket", "aov_bucket", B.LIFETIME_ORDERS_LABELS, B.AOV_LABELS, "sum",
                        "sale_orders"))
    for name, src in [("units_per_order_histogram", "tx"),
                      ("units_per_order_histogram_repeat", "(SELECT * FROM tx WHERE is_repeat > 0.0)")]:
        c, f2 = hist_sql(src, "units")
        _tx_report(name, c, f2)
    _tx_report("units_by_date", "", mean_by_sql("tx", "order_date", "units", ["is_repeat"]))
    _tx_report("positive_adjustments", "", rounded_select(ORDER_FACT_COLUMNS, ORDER_FACT_DOUBLES,
                                                          "(SELECT * FROM tx WHERE adjustment_total > 0.0)"))
    _tx_report("first_positive_adjustments", "", rounded_select(
        ORDER_FACT_COLUMNS, ORDER_FACT_DOUBLES, "(SELECT * FROM tx WHERE adjustment_total > 0.0 ORDER BY order_id LIMIT 5)"))
    _tx_report("guest_penetration_matrix", f"""
gu AS {cust('max(is_guest)', 'is_guest')},
gp AS (SELECT aov_bucket, order_count_bucket, count(*) AS users, count(*) FILTER (WHERE is_guest > 0.0) AS guest_users
       FROM gu WHERE aov_bucket IS NOT NULL AND order_count_bucket IS NOT NULL GROUP BY 1, 2),
gl AS (SELECT a.aov_bucket, o.order_count_bucket,
         CAST(coalesce(g.guest_users, 0) AS DOUBLE) / nullif(coalesce(g.users, 0), 0) AS v
       FROM {labels_sql('aov_bucket', B.AOV_LABELS)} a
         CROSS JOIN {labels_sql('order_count_bucket', B.LIFETIME_ORDERS_LABELS)} o
         LEFT JOIN gp g ON g.aov_bucket = a.aov_bucket AND g.order_count_bucket = o.order_count_bucket)
""", "SELECT order_count_bucket, " + ", ".join(
        f"{_r(f'max(CASE WHEN aov_bucket = {q([lab])} THEN v END)')} AS \"{lab}\"" for lab in B.AOV_LABELS)
        + " FROM gl GROUP BY 1")
    _tx_report("orders_by_sale_flag", "", """
SELECT has_sale_item, count(*) AS orders FROM tx WHERE has_sale_item IS NOT NULL GROUP BY 1""")


_register_report_oracles()


@oracle("ambiguous_visitors")
def _ambiguous_visitors():
    return with_adapter(DISTINCT_TO_EMAIL, """
SELECT distinct_id, count(*) AS emails FROM distinct_to_email GROUP BY 1 HAVING count(*) > 1""")


@oracle("event_classes")
def _event_classes():
    return with_adapter("", f"""
SELECT distinct_id, lower(email) AS email, time, name, {class_case()} AS event, {path_case()} AS path_name,
  CASE WHEN trim(os) IN ({MOBILE}) THEN 'mobile' ELSE 'desktop' END AS platform,
  CAST(CAST(time AS DATE) AS TIMESTAMP) AS day
FROM m_events""")


ORACLE["order_facts_from_buckets"] = ORACLE["order_facts"]


@oracle("bag_likelihood_bootstrap")
def _bag_likelihood_bootstrap():
    from basketlens.operators.stats import poisson_steps
    draws = []
    for i in range(4):
        u = f"(('0x' || h[{8 * i + 1}:{8 * i + 8}])::UBIGINT / 4294967296.0::DOUBLE)"
        draws.append("(" + " + ".join(f"({u} >= {s!r}::DOUBLE)::INTEGER" for s in poisson_steps()) + f") AS w{i}")
    means = ", ".join(f"sum(w{i} * y) / nullif(sum(w{i}), 0)::DOUBLE" for i in range(4))
    return with_adapter(VIEWS_PER_BAG_CTES + f""",
seen AS (SELECT product AS views, bag_indicator AS y, distinct_id || '|' || CAST(day AS VARCHAR) AS id FROM vpb WHERE product IS NOT NULL),
hashed AS (SELECT views, y, b, md5(concat('1:', b, ':', id)) AS h FROM seen, range(50) t(b)),
drawn AS (SELECT views, y, b, {", ".join(draws)} FROM hashed),
means AS (SELECT views, unnest([{means}]) AS m FROM drawn GROUP BY views, b),
plain AS (SELECT views, avg(y) AS m, count(y) AS n, stddev_samp(y) AS s FROM seen GROUP BY views),
spread AS (SELECT views, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY views)
""", """SELECT views, __R6__(p.m)__R6END__ AS bag_likelihood, p.n, __R6__(p.s)__R6END__ AS std,
  __R6__(lo)__R6END__ AS ci_low, __R6__(hi)__R6END__ AS ci_high FROM plain p JOIN spread USING (views)""")


@oracle("users_from_daily_sketches")
def _users_from_daily_sketches():
    a, b = td.SKETCH_WINDOW
    return with_adapter("", f"""
SELECT {class_case()} AS event, count(DISTINCT distinct_id) AS users, count(DISTINCT CAST(time AS DATE)) AS days
FROM m_events WHERE CAST(time AS DATE) BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1""")


@oracle("rejected_product_ids")
def _rejected_product_ids():
    return with_adapter("", """
SELECT 'product_id' AS "column", v AS value, count(*) AS events, count(DISTINCT distinct_id) AS visitors
FROM (SELECT distinct_id, json_extract_string(properties, '$.product_id') AS v FROM m_events)
WHERE v IS NOT NULL AND trim(v) <> '' AND TRY_CAST(v AS DOUBLE) IS NULL GROUP BY 2""")


@oracle("sql_orders_by_state")
def _sql_orders_by_state():
    return with_adapter("", """
SELECT state, count(*) AS orders, count(DISTINCT lower(email)) AS customers FROM m_orders
WHERE completed_at BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2022-01-01' AND state IN ('complete', 'returned') GROUP BY state""")


@oracle("csv_orders")
def _csv_orders():
    return with_adapter("", "SELECT id, email, number, completed_at, __R6__(item_total)__R6END__ AS item_total FROM m_orders")


@oracle("report_json_orders")
def _report_json_orders():
    return with_adapter("", "SELECT id, state, email FROM m_orders")


@oracle("sheet_orders_by_state")
def _sheet_orders_by_state():
    return with_adapter("", "SELECT state, count(*) AS orders FROM m_orders GROUP BY state")


@oracle("orders_per_month")
def _orders_per_month():
    return with_adapter("""
done AS (SELECT CAST(date_trunc('month', completed_at) AS DATE) AS month FROM m_orders WHERE completed_at IS NOT NULL),
months AS (SELECT CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM done)
""", "SELECT m.month, count(d.month) AS orders FROM months m LEFT JOIN done d USING (month) GROUP BY m.month ORDER BY 1")
