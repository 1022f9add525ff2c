"""Declared-type coercion and column renaming."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

NUMBER_TEXT = r"[$,]"


def to_number(col):
    """Text or number -> double: strip ``$`` and ``,``; ``''`` and unparsable -> null."""
    return _try_double(F.regexp_replace(F.col(col).cast("string"), NUMBER_TEXT, ""))


def _try_double(s):
    return F.when(F.trim(s) == "", F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def coerce_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply a declared name->kind map to the columns that are present:
    str -> text with null as ''; num -> double; ts -> timestamp_ntz; id -> bigint."""
    out = []
    for f in df.schema.fields:
        kind = types.get(f.name)
        c = F.col(f.name)
        if kind == "str":
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif kind == "num":
            c = _try_double(F.regexp_replace(c.cast("string"), NUMBER_TEXT, "")) \
                if f.dataType.typeName() == "string" else c.cast("double")
        elif kind == "ts":
            c = c.try_cast("timestamp_ntz") if f.dataType.typeName() == "string" else c.cast("timestamp_ntz")
        elif kind == "id":
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def number_rejects(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per numeric text column, how many non-empty values did not parse."""
    aggs = []
    for f in df.schema.fields:
        if types.get(f.name) == "num" and f.dataType.typeName() == "string":
            s = F.regexp_replace(F.col(f.name), NUMBER_TEXT, "")
            bad = F.col(f.name).isNotNull() & (F.trim(s) != "") & s.try_cast("double").isNull()
            aggs.append(F.count_if(bad).alias(f.name))
    return df.agg(*aggs) if aggs else df.sparkSession.range(1).select()


class Coerced(NamedTuple):
    clean: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def coerce_with_rejects(df: DataFrame, types: dict[str, str], keys: list[str], strict: bool = False) -> Coerced:
    """P19/N7 with both outputs of one pass: ``clean`` (``coerce_types``),
    ``rejects`` (``keys``, column, value), one row per text value that is
    neither empty nor parsable, and ``counts`` (rows, and rejects per column),
    observed while the rows are written once. ``strict`` raises an error for any
    reject, as the analysis did.

    A key column that is itself coerced appears in ``rejects`` as it was read."""
    from basketlens.session import cut_lineage
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and types.get(f.name) in ("num", "ts")]
    parsed = {}
    for name in text:
        raw = F.col(name)
        if types[name] == "num":
            raw = F.regexp_replace(raw, NUMBER_TEXT, "")
            parsed[name] = _try_double(raw)
        else:
            parsed[name] = raw.try_cast("timestamp_ntz")
    bad = {c: F.coalesce(F.col(c).isNotNull() & (F.trim(F.regexp_replace(F.col(c), NUMBER_TEXT, "") if types[c] == "num" else F.col(c)) != "")
                         & parsed[c].isNull(), F.lit(False)) for c in text}
    found = [F.when(bad[c], F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in text]
    none = F.array().cast("array<struct<column:string,value:string>>")
    marked = df.withColumn("_rejects", F.filter(F.array(*found), lambda r: r.isNotNull()) if found else none)
    # The keys as read are needed for rejected rows alone.
    marked = marked.withColumn("_keys", F.when(F.size("_rejects") > 0, F.struct(*[F.col(k) for k in keys])))
    seen = Observation()
    watched = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad[c]).alias(c) for c in text])
    table = cut_lineage(coerce_types(watched, types))
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    if strict and any(v for k, v in counts.items() if k != "rows"):
        raise ValueError(f"values that do not parse: { {k: v for k, v in counts.items() if v and k != 'rows'} }")
    rejects = (table.where(F.size("_rejects") > 0).select("_keys", F.explode("_rejects").alias("_r"))
                    .select("_keys.*", F.col("_r.column").alias("column"), F.col("_r.value").alias("value")))
    return Coerced(table.drop("_rejects", "_keys"), rejects, counts)


def rename_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map; keys that are not columns are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
