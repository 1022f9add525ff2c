"""Skew-safe sequence numbering and exact quantiles.

``row_number() over (partition by key order by ...)`` puts every row of a key
in one task; a key holding a third of the table would then be sorted by a
single task. ``sequence_number`` computes the same numbers from runs, with
DataFrame operations alone:

1. ``repartitionByRange(n, key, order)``: sampled bounds split a hot key over
   many ranges (the order columns must make the order total). Only the key, the
   order and the columns asked for are written, once, with their range number,
   so every later read sees the same ranges.
   A range is written in order, with every row's place in it.
2. Within a range rows are numbered per key by a window; a window group is at
   most one range.
3. A key's rows in earlier ranges are added. Rows are sorted across ranges, so
   only the lowest key of a range, that of its first row, can have any: the counts
   of those keys per range are a table of at most two rows a range, summed up and
   broadcast.

With no key it yields global 1-based positions in the sort order: the place in
the range and the rows of the ranges before, without a further shuffle.

``exact_quantiles`` numbers no rows: a mergeable sketch bounds the values that
can hold a wanted rank, and one further pass counts only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

_RANGE = "_sq_range"
_PLACE = "_sq_place"


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    """Null-safe equality (nulls equal nulls, NaN equals NaN)."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def sequence_number(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                    num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` per ``keys`` in ``order`` (ascending, nulls first;
    pass column names). ``order`` plus ``keys`` must identify a row uniquely
    for the numbering to be deterministic. All columns of ``df`` go through one
    range shuffle and one written table: pass narrow rows."""
    from basketlens.session import cut_lineage
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The lower 33 bits of the id count the rows of a partition from 0, in their order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1))
    rows = cut_lineage(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                         .select("*", F.spark_partition_id().alias(_RANGE), place.alias(_PLACE)))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    local = F.row_number().over(Window.partitionBy(_RANGE, *keys).orderBy(*order)).cast("long")
    if not keys:
        counts = rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n"))
        carry = counts.select(_RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
        return rows.join(F.broadcast(carry), _RANGE).select(*df.columns, (F.col(_PLACE) + 1 + F.col("_carry")).alias(out))

    names = [f"_k{i}" for i in range(len(keys))]
    firsts = rows.where(F.col(_PLACE) == 0).select(*[F.col(k).alias(a) for k, a in zip(keys, names)]).distinct()
    named = rows.select(_RANGE, *[F.col(k).alias(a) for k, a in zip(keys, names)])
    counts = (named.join(F.broadcast(firsts), _same(named, firsts, names), "left_semi")
                   .groupBy(_RANGE, *names).agg(F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy(*names).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (counts.withColumn("_carry", F.sum("_n").over(earlier)).where(F.col("_carry") > 0)
                   .select(F.col(_RANGE).alias("_r"), *names, "_carry"))
    numbered = rows.withColumn(out, local)
    found = (numbered[_RANGE] == carry["_r"])
    for k, a in zip(keys, names):
        found = found & numbered[k].eqNullSafe(carry[a])
    return (numbered.join(F.broadcast(carry), found, "left")
                    .select(*df.columns, (F.col(out) + F.coalesce(F.col("_carry"), F.lit(0))).alias(out)))


#: Relative rank error of the sketch is 1 / ACCURACY; a bracket then holds about
#: 2 / ACCURACY of the rows.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group_name: str = "prob",
                    by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas 'linear', DuckDB
    ``quantile_cont``) of ``col``, per ``by`` where given, as (by, prob, value).
    Null values and rows with a null ``by`` are ignored; an empty input has no
    rows.

    Exact selection in two passes, with no table written. A mergeable quantile
    sketch gives, for every wanted rank, a lower and an upper value that it lies
    between (the sketch's error is bounded, so this is certain). The second pass
    counts the rows below each such bracket and the distinct values inside it,
    all partial aggregates; a bracket holds about 2 / ``accuracy`` of the rows,
    besides copies of its values, which are one row each."""
    by = list(by or [])
    base = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    for k in by:
        base = base.where(F.col(k).isNotNull())
    slack = 2.0 / accuracy
    # One sketch answers for both ends of every bracket: the lower ones first.
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = base.groupBy(*by).agg(F.percentile_approx("_x", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_ends"),
                                   F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count(F.lit(1)).alias("_total"))
    # A bracket at an end of the data takes in the end itself; a group so small
    # that the slack is only a few rows is one bracket.
    few = F.col("_total") < 10 * accuracy
    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.when(few | F.lit(p <= slack), F.col("_min")).otherwise(F.col("_ends")[i]).alias("low"),
                 F.when(few | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_ends")[len(probs) + i]).alias("high"))
        for i, p in enumerate(probs)])
    sketch = sketch.select(*by, "_total", brackets.alias("_b")).where(F.col("_total") > 0)
    # One row without groups; with groups as many as there are, so AQE decides.
    joined = base.join(sketch, by) if by else base.crossJoin(F.broadcast(sketch))
    # Per row the brackets it lies in or below; rows above all of them drop out.
    hit = F.filter(F.transform("_b", lambda b: F.struct(b["i"].alias("i"), F.when(F.col("_x") >= b["low"], F.col("_x")).alias("x"), (F.col("_x") <= b["high"]).alias("in"))), lambda t: t["in"])
    counted = (joined.select(*by, "_total", F.explode(hit).alias("t"))
                     .groupBy(*by, "_total", F.col("t.i").alias("_i"), F.col("t.x").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    # A null value is the count below its bracket: it comes first.
    upto = Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")]
    rank = prob * (F.col("_total") - 1)
    placed = counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_rank", rank)

    def holds(at):
        return F.col("_v").isNotNull() & (at + 1 <= F.col("_upto")) & (at + 1 > F.col("_upto") - F.col("_n"))
    found = placed.groupBy(*by, "_i").agg(
        F.max("_rank").alias("_rank"), F.max(F.when(holds(F.floor("_rank")), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.ceil("_rank")), F.col("_v"))).alias("_hi"))
    sure = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))
    return found.select(*by, F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")].alias(group_name), sure.otherwise(value).alias("value"))
