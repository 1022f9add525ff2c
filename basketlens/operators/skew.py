"""Joins on a key that some rows lack and few values dominate.

A left join sends every row with a null key to one reducer, and every row of a
very frequent key to another. ``left_join`` keeps rows without a key out of the
join and deals the frequent keys' rows over salts, with the other side's rows of
those keys repeated per salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of the rows are found; so at most 1 / share.
HEAVY_SHARE = 1e-3
SALTS = 32


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Every key value held by more than ``share`` of the rows, so fewer than
    1 / share of them, from the count per key (a partial aggregate). Nulls are
    left out."""
    keyed = df.select(key).where(F.col(key).isNotNull())
    found = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share * keyed.count())
    return sorted(r[0] for r in found.collect())


def left_join(left: DataFrame, right: DataFrame, key: str, heavy: list, salts: int = SALTS) -> DataFrame:
    """``left.join(right, key, "left")`` with the keys of ``heavy`` (see
    ``heavy_keys``) salted and null keys kept out of the shuffle. Right columns
    must not share a name with left ones besides ``key``."""
    # Rows without a key find no partner: they stay where they are.
    without = left.where(F.col(key).isNull())
    keyed = left.where(F.col(key).isNotNull())
    if not heavy:
        return keyed.join(right, key, "left").unionByName(without, allowMissingColumns=True)
    hot = F.col(key).isin(*heavy)
    keyed = keyed.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)))
    each = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = right.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(each))
    return keyed.join(dealt, [key, "_salt"], "left").drop("_salt").unionByName(without, allowMissingColumns=True)
