"""Distributed statistics behind the analysis charts: group sizes, percent of
group, mean with interval, dense cohort grids, histograms, CDFs, exact
quantiles and summaries.

Nothing here collects rows. Anything global (quantile edges, histogram
bounds) is a one-row aggregate joined back with a broadcast of that one row;
exact order statistics come from a sketch and the counts inside its brackets
(``basketlens.operators.sequence``), never from a single-partition window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

Z95 = 1.959963984540054


def mean_by(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Mean of ``y`` per ``x`` (and hue/style keys) with a closed-form 95%
    interval mean +- z*s/sqrt(n). Rows with a missing x or y are left out."""
    g = [x, *keys]
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    out = base.groupBy(*g).agg(F.avg(y).alias("mean"), F.count(y).alias("n"),
                               F.stddev_samp(y).alias("std"))
    half = F.lit(Z95) * F.col("std") / F.sqrt(F.col("n"))
    return (out.withColumn("ci_low", F.col("mean") - half)
               .withColumn("ci_high", F.col("mean") + half)
               .orderBy(*[F.asc_nulls_last(c) for c in g]))


def poisson_steps(beyond: float = 1e-10) -> list[float]:
    """P(N <= k) of a Poisson variable with mean 1 for k = 0, 1, ... until what
    is left is below ``beyond``."""
    steps, term, k = [], math.exp(-1.0), 0
    while not steps or 1.0 - steps[-1] > beyond:
        steps.append((steps[-1] if steps else 0.0) + term)
        k += 1
        term /= k
    return steps


def bootstrap_mean_by(df: DataFrame, x: str, y: str, *keys: str, row_key: list[str], replicates: int = 200,
                      seed: int = 1) -> DataFrame:
    """A32 with a 95% bootstrap interval instead of the closed form (Poisson
    bootstrap): in each replicate every row counts a Poisson(1) number of times,
    and the interval spans the 2.5% and 97.5% quantiles of the replicates' means.

    A row's weights come from a digest of ``seed``, the replicate and the row's
    ``row_key``, so reruns, other partitionings and lost executors give the
    same interval. All replicates are one aggregate with a partial phase: a row
    becomes ``replicates / 4`` rows of four weights inside its task, and one row
    per group and four replicates is shuffled."""
    g = [x, *keys]
    base = df.where(F.col(y).isNotNull())
    for k in g:
        base = base.where(F.col(k).isNotNull())
    said = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in row_key])
    drawn = base.select(*g, F.col(y).cast("double").alias("_y"), said.alias("_id"),
                        F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))).alias("_b"))
    drawn = drawn.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_b").cast("string"), F.lit(":"), F.col("_id"))))
    steps = poisson_steps()

    def weight(i):
        u = F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return reduce(lambda a, b: a + b, [(u >= F.lit(s)).cast("int") for s in steps])
    drawn = drawn.select(*g, "_y", "_b", *[weight(i).alias(f"_w{i}") for i in range(4)])
    sums = drawn.groupBy(*g, "_b").agg(
        F.avg("_y").alias("mean"), F.count("_y").alias("n"), F.stddev_samp("_y").alias("std"),
        *[F.try_divide(F.sum(F.col(f"_w{i}") * F.col("_y")), F.sum(f"_w{i}").cast("double")).alias(f"_m{i}") for i in range(4)])
    # One row per group and four replicates from here on.
    each = sums.select(*g, "mean", "n", "std", F.explode(F.array(*[
        F.when(F.col("_b") * 4 + i < replicates, F.col(f"_m{i}")) for i in range(4)])).alias("_m"))
    out = each.groupBy(*g).agg(F.min("mean").alias("mean"), F.min("n").alias("n"), F.min("std").alias("std"),
                               F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    return (out.select(*g, "mean", "n", "std", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))
               .orderBy(*[F.asc_nulls_last(c) for c in g]))


def group_sizes(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key; rows with a null key are left out (pandas rule, N15)."""
    base = df
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def pct_of_total(counts: DataFrame, value: str, total: DataFrame, total_col: str,
                 name: str = "percentage") -> DataFrame:
    """Value / a one-row total * 100 (the total is one row, broadcast)."""
    return (counts.crossJoin(F.broadcast(total.select(F.col(total_col).alias("_total"))))
                  .withColumn(name, F.col(value) / F.col("_total") * 100.0).drop("_total"))


def dense_grid(df: DataFrame, row: str, col: str, row_labels, col_labels, aggs: dict,
               fill: dict | None = None) -> DataFrame:
    """Aggregate per (row, col) bucket and emit every label pair
    (a bucket pair without rows shows ``fill``), in label order.

    ``aggs`` maps output name -> aggregate Column. The cells are one literal
    relation of at most a few dozen rows; the data side is one partial
    aggregation of the rows in labelled buckets, so it has no more rows than
    there are cells and is broadcast."""
    spark = df.sparkSession
    g = (df.where(F.col(row).isin(list(row_labels)) & F.col(col).isin(list(col_labels)))
           .groupBy(row, col).agg(*[a.alias(n) for n, a in aggs.items()]))
    cells = spark.createDataFrame(
        [(r, i, c, j) for i, r in enumerate(row_labels) for j, c in enumerate(col_labels)],
        f"{row} string, {row}_ord int, {col} string, {col}_ord int")
    out = cells.join(F.broadcast(g), [row, col], "left")
    for n, v in (fill or {}).items():
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(v)))
    return out.orderBy(f"{row}_ord", f"{col}_ord").drop(f"{row}_ord", f"{col}_ord")


def cohort_grid(df: DataFrame, row: str, col: str, row_labels, col_labels, value: str | None = None,
                agg: str = "sum") -> DataFrame:
    """A22 (sum -> int, empty 0), A23 (count of rows, empty 0), A24 (mean,
    empty 0) and A25 (share = sum/count, empty cell null) in long form
    (row, col, value)."""
    if agg == "sum":
        return dense_grid(df, row, col, row_labels, col_labels,
                          {"value": F.sum(value)}, {"value": 0}).withColumn("value", F.col("value").cast("long"))
    if agg == "count":
        return dense_grid(df, row, col, row_labels, col_labels,
                          {"value": F.count(F.lit(1))}, {"value": 0}).withColumn("value", F.col("value").cast("long"))
    if agg == "mean":
        return dense_grid(df, row, col, row_labels, col_labels, {"value": F.avg(value)}, {"value": 0.0})
    if agg == "share":
        g = dense_grid(df, row, col, row_labels, col_labels,
                       {"_s": F.sum(value), "_n": F.count(F.lit(1))}, {"_s": 0.0, "_n": 0})
        return g.withColumn("value", F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double"))) \
                .drop("_s", "_n")
    raise ValueError(agg)


def cohort_grids(df: DataFrame, col: str, col_labels, grids: list[tuple]) -> DataFrame:
    """A22-A25 for all grids of a report in one pass: ``grids`` lists (name, row
    column, row labels, agg, value column or None) as in ``cohort_grid``, all
    over the same column labels. Result (grid, row_bucket, col_bucket, value)
    in the order given.

    Every row column is one grouping set of a single aggregate with a partial
    phase; all sums and counts any grid needs are computed beside each other.
    The aggregate has at most one row per label pair and set (others are
    filtered out before), so it is broadcast to the literal list of cells."""
    rows = list(dict.fromkeys(r for _, r, _, _, _ in grids))
    values = list(dict.fromkeys(v for *_, v in grids if v))
    known = {r: list(labels) for _, r, labels, _, _ in grids}
    g = df.select(*[F.when(F.col(r).isin(known[r]), F.col(r)).alias(r) for r in rows],
                  col, *values).where(F.col(col).isin(list(col_labels)))
    g = g.groupingSets([[r, col] for r in rows], *rows, col).agg(
        F.count(F.lit(1)).alias("_n"),
        *[a for i, v in enumerate(values) for a in (F.sum(v).cast("double").alias(f"_s{i}"), F.count(v).alias(f"_c{i}"))],
        *[F.grouping(r).alias(f"_g{i}") for i, r in enumerate(rows)])
    of = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.lit(i)) for i in range(len(rows))])
    g = g.select(of.alias("_set"), F.coalesce(*rows).alias("row_bucket"), F.col(col).alias("col_bucket"), "_n",
                 *[c for i in range(len(values)) for c in (f"_s{i}", f"_c{i}")]).where(F.col("row_bucket").isNotNull())
    cells = df.sparkSession.createDataFrame(
        [(k, name, rows.index(r), i, a, j, b) for k, (name, r, labels, _, _) in enumerate(grids)
         for i, a in enumerate(labels) for j, b in enumerate(col_labels)],
        "_k int, grid string, _set int, _i int, row_bucket string, _j int, col_bucket string")
    out = cells.join(F.broadcast(g), ["_set", "row_bucket", "col_bucket"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")

    def value(agg, v):
        if agg == "count":
            return n
        i = values.index(v)
        total = F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        if agg == "sum":
            return total
        if agg == "mean":
            return F.coalesce(F.try_divide(total, F.col(f"_c{i}").cast("double")), F.lit(0.0))
        if agg == "share":
            return F.try_divide(total, n)
        raise ValueError(agg)
    shown = F.coalesce(*[F.when(F.col("_k") == k, value(agg, v)) for k, (*_, agg, v) in enumerate(grids)])
    return out.orderBy("_k", "_i", "_j").select("grid", "row_bucket", "col_bucket", shown.alias("value"))


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in an explicit order (nulls last), by heaps of n
    rows per partition."""
    return df.orderBy(*[F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]).limit(n)


def summary(df: DataFrame, col: str, percentiles=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
            ) -> DataFrame:
    """Count, mean, sample std, min, percentiles, max of ``col`` in one
    row (columns p10 ... p95); the median is always included; nulls ignored."""
    from basketlens.operators.sequence import exact_quantiles
    probs = sorted(set(list(percentiles) + [0.5]))
    base = df.where(F.col(col).isNotNull())
    stats = base.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                     F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    q = exact_quantiles(base, col, probs)
    wide = q.groupBy().pivot("prob", probs).agg(F.first("value"))
    wide = wide.select(*[F.col(f"`{c}`").alias(_pname(float(c))) for c in wide.columns])
    cols = ["count", "mean", "std", "min"] + [_pname(p) for p in probs] + ["max"]
    return stats.crossJoin(wide).select(*cols)


def _pname(p: float) -> str:
    return "p" + (f"{p * 100:.10g}").replace(".", "_")


def _bin_index(x, lo, hi, nbins):
    """numpy's equal-width bin index (with its edge corrections); last bin closed."""
    step = (hi - lo) / nbins
    norm = nbins / (hi - lo)
    i0 = F.floor((x - lo) * norm)
    i0 = F.when(i0 == nbins, nbins - 1).otherwise(i0)
    edge = lambda i: F.when(i == nbins, hi).otherwise(lo + i * step)
    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    return F.when((x >= edge(i1 + 1)) & (i1 != nbins - 1), i1 + 1).otherwise(i1)


def fd_bins(df: DataFrame, col: str, by: list[str], max_bins: int = 50) -> DataFrame:
    """Automatic bin count per group: Freedman-Diaconis width capped at
    ``max_bins`` (sqrt(n) when the IQR is 0, 1 bin below 2 values), as the
    plotting library chooses it; plus the data range."""
    from basketlens.operators.sequence import exact_quantiles
    base = df.where(F.col(col).isNotNull())
    stats = base.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).cast("double").alias("lo"),
                                  F.max(col).cast("double").alias("hi"))
    q = exact_quantiles(base, col, [0.25, 0.75], by=by)
    iqr = q.groupBy(*by).agg((F.max(F.when(F.col("prob") == 0.75, F.col("value")))
                              - F.max(F.when(F.col("prob") == 0.25, F.col("value")))).alias("iqr"))
    s = stats.join(iqr, by, "left") if by else stats.crossJoin(iqr)
    h = 2.0 * F.col("iqr") / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    fd = F.when(F.col("n") < 2, F.lit(1)).when(h == 0, F.floor(F.sqrt(F.col("n").cast("double"))).cast("long")) \
          .otherwise(F.ceil((F.col("hi") - F.col("lo")) / h).cast("long"))
    return s.withColumn("bins", F.least(fd, F.lit(max_bins)).cast("long"))


def histogram(df: DataFrame, col: str, by: list[str] | None = None, edges: list[float] | None = None,
              max_bins: int | None = 50, open_top: bool = False) -> DataFrame:
    """Dense histogram (bin, lo, hi, count, cumulative_fraction)
    per group. Without ``edges`` the bins are automatic and equal-width over
    the data range (numpy's assignment rule); with ``edges`` bin i is
    [e_i, e_{i+1}); the last bin is closed, or with ``open_top`` has no upper
    end, and values outside are in no bin. ``cumulative_fraction`` is the
    running count over all non-null rows. ``max_bins`` is the plotting rule
    of the reports: automatic bins never number more (None: no limit)."""
    by = list(by or [])
    spark = df.sparkSession
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull())
    if edges is None:
        b = fd_bins(base, col, by, max_bins)
        same = F.col("hi") == F.col("lo")
        b = (b.withColumn("lo", F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")))
              .withColumn("hi", F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi"))))
        # One row per group, read by both the binning and the dense bin list:
        # materialise it so the quartile pass behind it runs once.
        from basketlens.session import cut_lineage
        b = cut_lineage(b)
        # One bounds row per group: a broadcast of one row without groups; with
        # groups the size follows the group count, so AQE decides.
        joined = base.join(b.select(*by, "lo", "hi", "bins"), by, "inner") if by else \
            base.crossJoin(F.broadcast(b.select("lo", "hi", "bins")))
        idx = _bin_index(x, F.col("lo"), F.col("hi"), F.col("bins"))
        counts = joined.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        step = (F.col("hi") - F.col("lo")) / F.col("bins")
        all_bins = b.select(*by, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                        F.col("bins") - 1)).alias("bin"))
        all_bins = all_bins.select(
            *by, "bin",
            (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
            F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
             .otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("bin_hi"))
    else:
        nb = len(edges) - 1
        idx = None
        for i in range(nb):
            cond = x >= F.lit(float(edges[i]))
            if i < nb - 1:
                cond = cond & (x < F.lit(float(edges[i + 1])))
            elif not open_top:
                cond = cond & (x <= F.lit(float(edges[i + 1])))
            idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
        counts = (base.select(*by, idx.cast("long").alias("bin"))
                      .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
        lit_bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(nb)],
                                         "bin long, bin_lo double, bin_hi double")
        if by:
            lit_bins = base.select(*by).distinct().crossJoin(F.broadcast(lit_bins))
        all_bins = lit_bins
    total = counts.groupBy(*by).agg(F.sum("count").alias("_total"))
    out = all_bins.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce(F.col("count"), F.lit(0)))
    out = out.join(total, by, "left") if by else out.crossJoin(F.broadcast(total))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0) if by else \
        Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cumulative_fraction",
                         F.try_divide(F.sum("count").over(w).cast("double"), F.col("_total").cast("double")))
    return out.select(*by, "bin", "bin_lo", "bin_hi", "count", "cumulative_fraction").orderBy(*by, "bin")


def max_per_key(df: DataFrame, key: str) -> DataFrame:
    """Max of every other column per key."""
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in df.columns if c != key])


def subscription_groups(users: DataFrame, col: str = "orders_per_year", target_orders: float = 4.0) -> DataFrame:
    """New subscription orders per customer: max(0, target - floor(orders/yr)),
    grouped: (new_orders, n, start) in ascending new_orders, which is the
    order of a descending sort on orders per year. A handful of rows."""
    x = F.col(col)
    new_orders = F.greatest(F.lit(0.0), F.lit(target_orders) - F.floor(x).cast("double"))
    g = users.where(x.isNotNull()).groupBy(new_orders.alias("new_orders")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("new_orders").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def subscription_percentiles(users: DataFrame, revenue_per_order: float = 68.0, profit_per_order: float = 23.10,
                             col: str = "orders_per_year", percents=range(1, 51)) -> DataFrame:
    """W5/A35 closed form. Customers sorted by orders/yr descending receive
    running totals of new revenue, new profit and users; the p-th percentile
    of each running column (linear interpolation) is read off the step
    function total(r) = sum_v v * clamp(r - start_v, 0, n_v) at the two ranks
    around p/100*(N-1). No global sort or single-partition window over
    customers: the inputs are a few group rows."""
    spark = users.sparkSession
    g = subscription_groups(users, col)
    total = g.agg(F.sum("n").alias("_total_n"))
    p = spark.createDataFrame([(int(v),) for v in percents], "coverage_percentage int")
    t = (p.crossJoin(total)
          .withColumn("_k", F.col("coverage_percentage") / 100.0 * (F.col("_total_n") - 1))
          .withColumn("_r_lo", F.floor("_k") + 1).withColumn("_r_hi", F.ceil("_k") + 1)
          .withColumn("_frac", F.col("_k") - F.floor("_k")))
    j = t.crossJoin(F.broadcast(g))

    def orders_at(r):
        return F.col("new_orders") * F.least(F.greatest(r - F.col("start"), F.lit(0)), F.col("n"))
    per = j.groupBy("coverage_percentage", "_k", "_r_lo", "_r_hi", "_frac").agg(
        F.sum(orders_at(F.col("_r_lo"))).alias("_o_lo"), F.sum(orders_at(F.col("_r_hi"))).alias("_o_hi"))

    def lerp(lo, hi):
        return lo + (hi - lo) * F.col("_frac")
    return per.select(
        "coverage_percentage",
        lerp(F.col("_o_lo") * revenue_per_order, F.col("_o_hi") * revenue_per_order).alias("cumulative_new_revenue"),
        lerp(F.col("_o_lo") * profit_per_order, F.col("_o_hi") * profit_per_order).alias("cumulative_new_profit"),
        lerp(F.col("_r_lo").cast("double"), F.col("_r_hi").cast("double")).alias("cumulative_users"),
    ).orderBy("coverage_percentage")


def subscription_curve(users: DataFrame, revenue_per_order: float = 68.0, profit_per_order: float = 23.10,
                       col: str = "orders_per_year") -> DataFrame:
    """W5 curve vertices: after each new-orders group (ascending), the running
    users, new revenue and new profit; the per-customer curve is linear in
    between."""
    g = subscription_groups(users, col)
    w = Window.orderBy("new_orders").rowsBetween(Window.unboundedPreceding, 0)
    orders = F.sum(F.col("new_orders") * F.col("n")).over(w)
    return g.select("new_orders", "n", (F.col("start") + F.col("n")).alias("cumulative_users"),
                    (orders * revenue_per_order).alias("cumulative_new_revenue"),
                    (orders * profit_per_order).alias("cumulative_new_profit")).orderBy("new_orders")


def subscription_running_totals(users: DataFrame, revenue_per_order: float = 68.0, profit_per_order: float = 23.10,
                                col: str = "orders_per_year", key: str = "email", target_orders: float = 4.0) -> DataFrame:
    """W5, one row per customer: customers by orders per year descending (ties
    by ``key``) with the running number of users, new revenue and new profit.
    Customers without ``col`` are left out.

    The position comes from the distributed numbering; the running sums follow
    from it and the group rows (orders per year are not negative, so there are
    at most five), without a window over the customers."""
    from basketlens.operators.sequence import sequence_number
    g = subscription_groups(users, col, target_orders)
    before = Window.orderBy("new_orders").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select("new_orders", "start",
                 F.coalesce(F.sum(F.col("new_orders") * F.col("n")).over(before), F.lit(0.0)).alias("_orders"))
    x = F.col(col)
    rows = (users.where(x.isNotNull())
                 .select(key, col, (-x.cast("double")).alias("_down"),
                         F.greatest(F.lit(0.0), F.lit(target_orders) - F.floor(x).cast("double")).alias("new_orders")))
    rows = sequence_number(rows, [], ["_down", key], out="cumulative_users").join(F.broadcast(g), "new_orders")
    orders = F.col("_orders") + F.col("new_orders") * (F.col("cumulative_users") - F.col("start"))
    return rows.select(key, col, "new_orders", "cumulative_users",
                       (orders * revenue_per_order).alias("cumulative_new_revenue"),
                       (orders * profit_per_order).alias("cumulative_new_profit"))


def to_wide(long: DataFrame, row: str, col: str, value: str, col_labels, row_labels=None) -> DataFrame:
    """R-PIVOT: long (row, col, value) -> one column per fixed column label
    (the pivot values are given, so no extra pass discovers them)."""
    out = long.groupBy(row).pivot(col, list(col_labels)).agg(F.first(value))
    if row_labels is not None:
        order = F.array_position(F.array(*[F.lit(x) for x in row_labels]), F.col(row))
        out = out.orderBy(order)
    return out
