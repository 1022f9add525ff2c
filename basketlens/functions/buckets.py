"""B-CUT / B-QCUT: pandas-style bucketing as native expressions.

``bucketize`` follows ``pd.cut(x, edges, labels, right=False)``: bucket i is
[edges[i], edges[i+1]); out of range or missing -> null. With
``open_top=True`` the last bucket has no upper edge (the analysis used
``max(x) + 1`` as its last edge, which is the same except that it needs an
extra pass over the data).

``qcut_codes`` follows ``pd.qcut(x, q, labels=False, duplicates='drop')``:
edges are linear-interpolated quantiles, buckets are right-closed with the
lowest edge included, duplicate edges are dropped. Ties always share a
code (this is not ``ntile``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket edges and labels used by the analysis.
# The last bucket is open: the 100th and later orders count as well.
ORDER_INDEX_EDGES = [2, 3, 4, 5]
ORDER_INDEX_LABELS = ["2", "3", "4", "5+"]
LIFETIME_ORDERS_EDGES = [1, 2, 3, 4, 5, 6, 11]
LIFETIME_ORDERS_LABELS = ["1", "2", "3", "4", "5", "6-10", "11+"]
AOV_EDGES = [0, 50, 101]
AOV_LABELS = ["<50", "50-100", "100+"]
ORDERS_PER_QUARTER_EDGES = [0, 0.5, 1.0, 1.5, 2]
ORDERS_PER_QUARTER_LABELS = ["<0.5", "0.5", "1.0", "1.5", "2+"]
RATIO_EDGES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101]
RATIO_LABELS = ["0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-100"]


def _ranges(edges, n_labels, open_top):
    out = []
    for i in range(n_labels):
        lo = edges[i]
        hi = None if (open_top and i == n_labels - 1) else edges[i + 1]
        out.append((lo, hi))
    return out


def bucketize(col, edges, labels, open_top: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expected = len(edges) if open_top else len(edges) - 1
    if len(labels) != expected:
        raise ValueError("labels do not fit the edges")
    expr = None
    for (lo, hi), lab in zip(_ranges(edges, len(labels), open_top), labels):
        cond = c >= F.lit(lo)
        if hi is not None:
            cond = cond & (c < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def label_table(spark, name: str, labels) -> DataFrame:
    """Ordered label list as a tiny relation (for dense grids, N12)."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], f"{name} string, {name}_ord int")


def qcut_edges(df: DataFrame, col: str, q: int = 10, digits: int = 9, approx: bool = False,
               accuracy: int = 100000) -> DataFrame:
    """One row with the sorted distinct quantile edges: exact and distributed,
    or with ``approx=True`` from a mergeable quantile sketch (for continuous
    columns where exactness is not needed)."""
    from basketlens.operators.sequence import exact_quantiles
    probs = [i / q for i in range(q + 1)]
    if approx:
        x = F.col(col).cast("double")
        edges = F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy)
        return df.agg(F.array_distinct(F.array_sort(F.transform(edges, lambda e: F.round(e, digits)))).alias("_edges"))
    qs = exact_quantiles(df, col, probs)
    return qs.agg(F.array_distinct(F.array_sort(F.collect_list(F.round("value", digits)))).alias("_edges"))


def qcut_codes(df: DataFrame, col: str, out: str, q: int = 10, approx: bool = False,
               edges: DataFrame | None = None) -> DataFrame:
    """Attach ``out`` = the qcut code of ``col`` (0-based; null stays null).
    ``edges`` (one row of ``qcut_edges``) may come from a narrower table that
    has the same values."""
    edges = edges if edges is not None else qcut_edges(df, col, q, approx=approx)
    x = F.col(col).cast("double")
    code = F.greatest(F.size(F.filter(F.col("_edges"), lambda e: e < x)) - 1, F.lit(0))
    return (df.crossJoin(F.broadcast(edges))
              .withColumn(out, F.when(x.isNotNull(), code).cast("long"))
              .drop("_edges"))
