"""Mixing sources to target weights by pivotal dependent rounding, in
DataFrame and SQL functions only.

A source's target divided by its size is every one of its documents' number of
copies, between 0 and 2. The whole part is taken at once; the fractional parts
are rounded together: two documents of a source meet, a random one gains and
the other loses the same number of words until one of them reaches no copy or
a whole one, and the other goes on to the next meeting. Each meeting keeps the
words of the pair and, over the random choice, each document's probability; so
a source's words stay at its target throughout. Meetings run in blocks of about
FAN_IN documents (``aggregate`` over a bounded array); the one open document of
a block goes up to the next level, a tree of log(n) / log(FAN_IN) levels whatever
the share of one source. What is open at the root takes the rest of the target:
the beginning of one copy, or, with ``whole_copies``, a whole copy or none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, read_table, whole

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5  # words of the mix, as a share of all words
MOST = 2.0  # copies of a source at most
FAN_IN = 64
WORD = "[^\\x20\\x09-\\x0D]+"

# One meeting of the open document a.cur (words w, probability p) with x.
_MEET = """
aggregate(members, cast(null as {state}), (a, x) -> case when a is null then named_struct('cur', x, 'done', cast(array() as array<{item}>)) else
 transform(array(named_struct(
   'up', least((1 - a.cur.p) * a.cur.w, x.p * x.w),
   'down', least(a.cur.p * a.cur.w, (1 - x.p) * x.w),
   'u', (xxhash64({seed}, a.cur.h, x.h) & 9007199254740991) / 9007199254740992D)), t ->
  case when t.u * (t.up + t.down) < t.down then
    case when (1 - a.cur.p) * a.cur.w <= x.p * x.w
    then named_struct('cur', {x_minus}, 'done', concat(a.done, array({cur_one})))
    else named_struct('cur', {cur_plus}, 'done', concat(a.done, array({x_none}))) end
  else
    case when a.cur.p * a.cur.w <= (1 - x.p) * x.w
    then named_struct('cur', {x_plus}, 'done', concat(a.done, array({cur_none})))
    else named_struct('cur', {cur_minus}, 'done', concat(a.done, array({x_one}))) end
  end)[0] end)
"""


def _with_p(row: str, p: str) -> str:
    return f"named_struct('h', {row}.h, 'id', {row}.id, 'w', {row}.w, 'p', {p})"


def _meetings(seed: int) -> str:
    item = "struct<h:bigint,id:bigint,w:double,p:double>"
    bounded = lambda p: f"least(1D, greatest(0D, {p}))"
    return _MEET.format(item=item, state=f"struct<cur:{item},done:array<{item}>>", seed=int(seed),
                        cur_one=_with_p("a.cur", "1D"), cur_none=_with_p("a.cur", "0D"), x_one=_with_p("x", "1D"), x_none=_with_p("x", "0D"),
                        x_minus=_with_p("x", bounded("x.p - t.up / x.w")), x_plus=_with_p("x", bounded("x.p + t.down / x.w")),
                        cur_plus=_with_p("a.cur", bounded("a.cur.p + t.up / a.cur.w")), cur_minus=_with_p("a.cur", bounded("a.cur.p - t.down / a.cur.w")))


def source_targets(scratch: Scratch, sized: DataFrame) -> DataFrame:
    """(source, source_size, items, target): targets share TOTAL of all words
    by weight; a source stops at MOST times its size and the excess is shared
    again by weight until none is above."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = scratch.table("placed", sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    # Ranks: rows before each output partition (as many as partitions) plus the place inside.
    part, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.pmod(F.col("before") + inside, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = scratch.table("ranked", placed.withColumn("part", part).join(before, "part").select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("most")))
    total = TOTAL * float(sized.agg(F.sum("size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level rises until no further source is full
        row = ranked.agg(F.count_if(F.col("most") <= F.lit(level) * F.col("weight")).alias("full"),
                         F.sum(F.when(F.col("most") <= F.lit(level) * F.col("weight"), F.col("most")).otherwise(0.0)).alias("held"),
                         F.sum(F.when(F.col("most") <= F.lit(level) * F.col("weight"), 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], max(level, (total - row["held"]) / row["open"])
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 7, whole_copies: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source) -> doc_id, source, size, source_size,
    target, copies (whole part taken), rest (probability that was left open at
    the root, else 0), taken: one row per input row.

    Null and empty texts have size 0 and take nothing. Null sources are a
    source of their own, last in order. Rows that repeat doc_id, source and
    size share one decision. Empty input gives no rows; reruns agree."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.table("sized", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                               F.regexp_count(whole(F.col("text").cast("string")), F.lit(WORD)).cast("long").alias("size")))
    sources = source_targets(scratch, sized)
    key = ["doc_id", "source", "size"]
    alike = sized.groupBy(*key).agg(F.count("*").alias("rows"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = (alike.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("i.*", share.alias("share"))
             .withColumn("base", F.floor("share")).withColumn("p", F.col("share") - F.col("base"))
             .withColumn("w", (F.col("size") * F.col("rows")).cast("double"))
             .withColumn("h", F.xxhash64(F.lit(seed), *key)))
    items = scratch.table("items", items.withColumn("id", F.monotonically_increasing_id()))
    open_ = items.filter("p > 0 and w > 0").select("source", "h", "id", "w", "p")
    decided, level = [], 0
    per_source = scratch.table("counts", open_.groupBy("source").agg(F.count("*").alias("n")))
    most = per_source.agg(F.max("n")).first()[0] or 0
    while most > 0:
        blocks = F.ceil(F.col("n") / F.lit(float(FAN_IN) ** (level + 1)))
        met = (open_.alias("o").join(per_source.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")))
               .select("o.source", F.pmod(F.xxhash64(F.lit(seed + level), "o.h"), blocks).alias("block"), F.struct("o.h", "o.id", "o.w", "o.p").alias("member"))
               .groupBy("source", "block").agg(F.sort_array(F.collect_list("member")).alias("members"))
               .select("source", F.expr(_meetings(seed + level)).alias("met")))
        met = scratch.table(f"level{level}", met)
        decided.append(met.select(F.explode("met.done").alias("d")).select("d.id", "d.p", F.lit(False).alias("root")))
        open_ = met.select("source", "met.cur.*")
        most = math.ceil(most / FAN_IN) if most > FAN_IN else 0
        level += 1
    decided.append(open_.select("id", "p", F.lit(True).alias("root")))
    settled = decided[0]
    for d in decided[1:]:
        settled = settled.union(d)
    # Texts without words take no words; they follow their own chance.
    chance = F.xxhash64(F.lit(seed + 1), "h").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    done = items.join(settled.select("id", F.col("p").alias("got"), "root"), "id", "left")
    root, got = F.coalesce("root", F.lit(False)), F.coalesce("got", F.when(F.col("w") == 0, (chance < F.col("p")).cast("double")).otherwise(F.lit(0.0)))
    if whole_copies:
        got, root = F.when(root, (chance < F.col("got")).cast("double")).otherwise(got), F.lit(False)
    done = done.select(*[F.col(k).alias(f"_{k}") for k in key], (F.col("base") + F.when(root, 0.0).otherwise(got)).cast("int").alias("copies"),
                       F.when(root, F.col("got")).otherwise(0.0).alias("rest"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return (sized.join(done, same[0] & same[1] & same[2]).select(*key, "copies", "rest")
            .alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("d.*", "s.source_size", "s.target",
                    (F.col("copies") * F.col("size") + F.floor(F.col("rest") * F.col("size") + 0.5)).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` (all its columns, whatever their names), each as
    many times as the mix takes it. Null and empty texts follow their source's
    number of copies; equal rows share a decision; empty input gives no rows."""
    copies = (mix(docs, seed, whole_copies=True).filter("copies > 0")
              .groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")))
    rows = packed(docs, id=F.col("doc_id").cast("long"), origin=F.col("source").cast("string"), words=F.regexp_count(whole(F.col("text").cast("string")), F.lit(WORD)).cast("long"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("origin").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
