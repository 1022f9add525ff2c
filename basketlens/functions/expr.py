"""Row-wise expressions shared by every query: page classification, event
renaming, platform, order validity, flags, JSON access, safe division.

All helpers return ``Column`` objects built from native functions so they
stay inside whole-stage codegen and push down where possible.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the analysed shop's own vocabulary for the
# results to match (event names as tracked, page classes, path vocabulary,
# mobile operating systems, non-merchandise product names, sale patterns).
# ---------------------------------------------------------------------------
PAGE_CLASSES = [
    ("product", ["products.show", "Product viewed"]),
    ("bag", ["Line items added"]),
    ("product_list", ["products.index"]),
    ("home", ["home", "viewedHomepage"]),
    ("checkout_start", ["Started Checkout Process"]),
    ("checkout", ["Checkout completed"]),
]
OTHER_CLASS = "other"
TRACKED_EVENT_NAMES = [
    "Product viewed",
    "products.show",
    "products.index",
    "home",
    "viewedHomepage",
    "Started Checkout Process",
    "Checkout completed",
    "Line items added",
]
VIEW_BAG_EVENT_NAMES = ["Product viewed", "products.show", "Line items added"]
PATH_NAMES = {
    "Product viewed": "pdp",
    "products.show": "pdp",
    "products.index": "plp",
    "home": "home",
    "viewedHomepage": "home",
    "Started Checkout Process": "checkout_start",
    "Checkout completed": "checkout",
    "Line items added": "add_to_bag",
}
MOBILE_OS = ["Windows Mobile", "BlackBerry", "Android", "Windows Phone", "iOS"]
NON_MERCH_PRODUCTS = ["the digital gift card", "conditional insert", "fedex delivery"]
SALE_NAME_PATTERNS = ("%sale%", "%clearance%")
SIZE_OPTION_TYPE = 9
COLOR_OPTION_TYPE = 2
# Default pattern of the shop's own staff e-mail domain (orders from staff are
# left out of order facts). Callers pass their shop's domain.
DEFAULT_STAFF_EMAIL_PATTERN = "%@staff.example.com%"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def page_class(name="name", classes=PAGE_CLASSES) -> Column:
    """Map a tracked event name to its page class, else 'other'."""
    name = _c(name)
    expr = None
    for label, names in classes:
        cond = name.isin(*names)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(OTHER_CLASS)


def page_class_narrow(name="name") -> Column:
    """Product / bag / other."""
    return page_class(name, [c for c in PAGE_CLASSES if c[0] in ("product", "bag")])


def path_name(name="name") -> Column:
    """Rename into the path vocabulary; unmapped names pass through."""
    name = _c(name)
    expr = None
    for raw, short in PATH_NAMES.items():
        expr = F.when(name == raw, short) if expr is None else expr.when(name == raw, short)
    return expr.otherwise(name)


def platform(os_col="os") -> Column:
    """Mobile when the trimmed OS is a mobile OS, else desktop (null too)."""
    return F.when(F.trim(_c(os_col)).isin(*MOBILE_OS), "mobile").otherwise("desktop")


def flag(cond: Column) -> Column:
    """Numeric 1.0/0.0 indicator; a null condition is 0.0."""
    return F.when(cond, 1.0).otherwise(0.0)


def to_ts(value) -> Column:
    """A date/datetime/ISO string literal as timestamp_ntz (a date is its midnight)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def time_between(start, end, col="time") -> Column:
    """Both ends inclusive; a date end means its midnight."""
    return _c(col).between(to_ts(start), to_ts(end))


def events_in(events: DataFrame, start, end) -> DataFrame:
    """P8 on a click-stream: start <= time <= end. Over the by-day layout (a
    column ``event_date``) the bound prunes partitions: other days are not read."""
    if "event_date" in events.columns:
        events = events.where(F.col("event_date").between(F.to_date(to_ts(start)), F.to_date(to_ts(end))))
    return events.where(time_between(start, end)).drop("event_date")


def day_of(col="time") -> Column:
    """Calendar day as timestamp_ntz midnight (zone independent, N14)."""
    return F.to_date(_c(col)).cast("timestamp_ntz")


def json_str(props, key: str) -> Column:
    """``props:key::string`` on a JSON text bag."""
    return F.get_json_object(_c(props), f"$.{key}")


def json_int(props, key: str) -> Column:
    """``props:key::int``; missing, null or non-numeric give null."""
    return F.expr(f"try_cast(get_json_object({_sql(props)}, '$.{key}') as int)")


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("json_int needs a column name")


def safe_div(a, b) -> Column:
    """x/0 -> null instead of an error (ANSI) or inf (pandas)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ratio_pct(a, b) -> Column:
    return safe_div(a, b) * F.lit(100.0)


def not_deleted(col="is_deleted") -> Column:
    return _c(col) == F.lit(False)


def merch_product(name="name") -> Column:
    """P10: product name not a non-merchandise item, or the name is null."""
    n = _c(name)
    return (~n.isin(*NON_MERCH_PRODUCTS)) | n.isNull()


def is_sale_name(name="name", patterns=SALE_NAME_PATTERNS) -> Column:
    """Case-insensitive pattern match on the product name; null -> false."""
    n = _c(name)
    cond = reduce(lambda a, b: a | b, [n.ilike(p) for p in patterns])
    return F.coalesce(cond, F.lit(False))


def valid_order(*, state=True, environment=True, not_deleted_=True,
                completed=True, alias: str | None = None) -> Column:
    """Order validity with switches, because each query's rule differs."""
    p = (alias + ".") if alias else ""
    conds = []
    if not_deleted_:
        conds.append(F.col(p + "is_deleted") == F.lit(False))
    if state:
        conds.append(F.col(p + "state") == F.lit("complete"))
    if environment:
        conds.append(F.col(p + "environment") == F.lit(0))
    if completed:
        conds.append(F.col(p + "completed_at").isNotNull())
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def py_strip_lower(col) -> Column:
    """Python ``lower().strip()`` (strips all white space, not only blanks)."""
    return F.regexp_replace(F.lower(_c(col)), r"^\s+|\s+$", "")


def epoch_seconds(col="time") -> Column:
    """seconds since epoch of a zone-less timestamp (read as UTC)."""
    return F.unix_micros(_c(col).cast("timestamp")) / F.lit(1e6)


def jitter(col, amount: float, seed: int = 7) -> Column:
    """uniform jitter in [-amount, amount)."""
    return _c(col) + (F.rand(seed) * 2.0 - 1.0) * F.lit(amount)
