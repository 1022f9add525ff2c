"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string is its polynomial at a fixed point modulo two
primes. Parts are hashed apart and combined by shifting a part's hash by the
length before it (multiplying by that power), so the segments of a huge document
are hashed by many tasks and a text's chunks in one matrix product. Rows with
equal length and fingerprint are then compared chunk by chunk with the first of
their bucket in a sorted stream; only equal bytes share a class.

A fingerprint that many rows share is dealt over buckets (square root of its
rows), and the buckets' first texts are compared with each other afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, INT, LONG, STRING, Scratch, read_table, schema, whole

#: Two primes below 2^31 and the points at which polynomials are evaluated.
PRIMES = (2147483629, 2147483587)
POINTS = (1220703125, 1162261467)
#: Bytes of a chunk: 2^13 products of a byte + 1 and a residue sum exactly in a double.
CHUNK = 1 << 13
#: Texts beyond it are hashed and compared as rows of segments.
SEGMENT = 1 << 16
#: Rows of one fingerprint from which it is dealt over buckets, and the most
#: such fingerprints that are listed (rarer ones then stay in one bucket).
HOT_ROWS, HOT_KEYS = 1024, 100_000
#: The filter of repeated fingerprints has at most so many bits (32 MB).
MOST_BITS = 1 << 28


def shifted(value: int, length: int, k: int) -> int:
    """A part's hash moved behind ``length`` bytes, modulo prime k."""
    return value * pow(POINTS[k], length, PRIMES[k]) % PRIMES[k]


def combined(parts: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """Hash of a concatenation from the (hash, length) of its parts."""
    at, out = 0, [0, 0]
    for value, length in parts:
        for k in (0, 1):
            out[k] = (out[k] + shifted(value[k], at, k)) % PRIMES[k]
        at += length
    return out[0], out[1]


class Polynomial:
    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        powers = [[1] * chunk, [1] * chunk]
        for k in (0, 1):
            for i in range(1, chunk):
                powers[k][i] = powers[k][i - 1] * POINTS[k] % PRIMES[k]
        self.powers = np.array(powers, np.float64).T.copy()
        self.step = tuple(pow(POINTS[k], chunk, PRIMES[k]) for k in (0, 1))

    def __call__(self, data: np.ndarray) -> tuple[int, int]:
        """Hash of bytes: all whole chunks at once, then shifted and added."""
        full = len(data) // self.chunk
        rest = (data[full * self.chunk:].astype(np.float64) + 1) @ self.powers[:len(data) - full * self.chunk]
        out = [int(x) % p for x, p in zip(rest, PRIMES)]
        if full:
            chunks = (data[:full * self.chunk].reshape(full, self.chunk).astype(np.float64) + 1) @ self.powers
            for row in chunks[::-1].astype(np.int64).tolist():
                out = [(o * s + x) % p for o, s, x, p in zip(out, self.step, row, PRIMES)]
        return out[0], out[1]


def joined(value: tuple[int, int]) -> int:
    return value[0] << 31 | value[1]


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    poly = Polynomial()
    for batch in batches:
        data = _bytes(batch.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([len(d) for d in data], pa.int64()), pa.array([joined(poly(d)) for d in data], pa.int64())], ["n_bytes", "print"])


def _hashed_segments(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial()
        for batch in batches:
            values = [poly(d) for d in _bytes(batch.column("part"))]
            at = [segment * s for s in batch.column("seg").to_pylist()]
            moved = [[shifted(v[k], n, k) for v, n in zip(values, at)] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(moved[0], pa.int64()), pa.array(moved[1], pa.int64())], ["uid", "first", "second"])
    return run


_DEALT = schema(uid=LONG, doc_id=LONG, n_bytes=LONG, print=LONG, sha=STRING, salt=INT, salts=INT, seg=INT, segs=INT, part=BINARY)


def _dealt(bitmap, bits: int, hot):
    """Rows with their fingerprint and bucket; the text goes along only if the
    filter does not prove the fingerprint unique."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, seen, buckets = Polynomial(), bitmap.value, hot.value
        for batch in batches:
            data, ids = batch.column("part").to_pylist(), batch.column("doc_id").to_pylist()
            prints = [joined(poly(np.frombuffer(d, np.uint8))) for d in data]
            place = np.array(prints, np.int64) % bits
            repeated = (seen[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            salts = [buckets.get((len(d), p), 1) for d, p in zip(data, prints)]
            # Equal ids of one batch go to buckets in turn, so a repeated or null id spreads too.
            times: dict = {}
            salt = []
            for i, p, n in zip(ids, prints, salts):
                if n > 1:
                    times[i, p] = turn = times.get((i, p), -1) + 1
                    salt.append((hash(i or 0) + turn) % n)
                else:
                    salt.append(0)
            zero, n = np.zeros(len(data), np.int32), len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int64)), batch.column("doc_id"), pa.array(map(len, data), pa.int64(), size=n), pa.array(prints, pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                 pa.array(salt, pa.int32()), pa.array(salts, pa.int32()), pa.array(zero), pa.array(zero + 1), pa.array([d if r else None for d, r in zip(data, repeated)], pa.binary())], _DEALT.names)
    return run


_COMPARED = T.StructType([f for f in _DEALT if f.name != "part"] + list(schema(label=STRING, part=BINARY)) + [T.StructField("same", T.BooleanType())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by length, fingerprint, bucket and segment: each chunk is
    compared with the first one of its run. ``label`` is the first row's digest
    for equal bytes; the first chunk goes along where a fingerprint has several
    buckets."""
    key = first = label = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("n_bytes", "print", "salt", "seg", "salts", "sha", "part")]
        labels, same, parts = [], [], []
        for n_bytes, print_, salt, seg, salts, sha, part in zip(*cols):
            if key != (n_bytes, print_, salt, seg):
                key, first, label = (n_bytes, print_, salt, seg), part, sha
                parts.append(part if salts > 1 else None)
            else:
                parts.append(None)
            same.append(part == first)
            labels.append(label if part == first else sha)
        keep = [batch.column(c) for c in _COMPARED.names[:-3]]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(labels, pa.string()), pa.array(parts, pa.binary()), pa.array(same, pa.bool_())], _COMPARED.names)


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First texts of buckets, sorted by class and segment: those that differ
    from the one before though they have one class."""
    key = first = None
    for batch in batches:
        found = []
        for *now, part in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "print", "label", "seg", "part"))):
            if now == key and part != first:
                found.append(now[2])
            key, first = now, part
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["label"])


def _same(column: Column) -> Column:
    return column


def duplicate_groups(docs: DataFrame, normalise: Callable[[Column], Column] = _same, segment: int = SEGMENT) -> DataFrame:
    """``docs`` (doc_id, text, any further columns, which are left out) ->
    doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Texts
    are equal if ``normalise`` makes the same bytes of them. Of a group the row
    with the largest doc_id stays: null is below every id, and of rows that
    repeat it one stays.

    Null texts count as empty, and all empty texts are one group. Texts beyond
    ``segment`` bytes are hashed and compared in segments by several tasks; no
    task holds more than two chunks of a group besides its Arrow batch. ``docs``
    is read twice and has to give the same rows both times, as a table does.
    Empty input gives no rows. Two different texts of one SHA-256 would end the
    query with an error."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = whole(normalise(F.col("text").cast("string"))).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("part"))
    small, size = rows.filter(F.octet_length("part") <= segment), F.octet_length("part")

    # Huge texts: segments are rows; their hashes, each shifted by its place, add up.
    whole_rows = scratch.table("huge", rows.filter(size > segment).withColumn("uid", F.monotonically_increasing_id())
                               .select("uid", "doc_id", size.cast("long").alias("n_bytes"), F.sha2("part", 256).alias("sha"), "part"))
    segs = F.ceil(F.col("n_bytes") / segment).cast("int")
    segments = (whole_rows.select("uid", "doc_id", "n_bytes", "sha", segs.alias("segs"), F.explode(F.sequence(F.lit(0), segs - 1)).alias("seg"), "part")
                .withColumn("part", F.substring("part", F.col("seg") * segment + 1, F.lit(segment))))
    sums = (segments.select("uid", "seg", "part").repartition("uid", "seg").mapInArrow(_hashed_segments(segment), schema(uid=LONG, first=LONG, second=LONG))
            .groupBy("uid").agg(*((F.sum(c) % p).alias(c) for c, p in zip(("first", "second"), PRIMES))))
    large = scratch.table("large", whole_rows.select("uid", "doc_id", "n_bytes", "sha").join(sums, "uid")
                          .withColumn("print", F.shiftleft("first", 31).bitwiseOR(F.col("second"))).drop("first", "second"))

    # Fingerprints of several rows.
    prints = small.select("part").mapInArrow(_counted, schema(n_bytes=LONG, print=LONG)).union(large.select("n_bytes", "print"))
    repeated = scratch.table("repeated", prints.groupBy("n_bytes", "print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    groups, members = repeated.agg(F.count(F.lit(1)), F.sum("n")).first()
    bits = min(MOST_BITS, 1 << max(15, (16 * groups).bit_length()))
    place = (F.col("print") % bits) + 1
    bitmap = np.zeros(bits >> 3, np.uint8)
    for r in repeated.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():
        at = (r["b"] - 1) * 4096
        bitmap[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)[:len(bitmap) - at]
    least = max(HOT_ROWS, (members or 0) // HOT_KEYS)
    buckets = {(r.n_bytes, r.print): r.salts for r in repeated.filter(F.col("n") > least).select("n_bytes", "print", F.ceil(F.sqrt("n")).cast("int").alias("salts")).collect()}

    # Comparison: equal length, fingerprint, bucket and segment meet in one sorted run.
    sc = spark.sparkContext
    dealt = small.mapInArrow(_dealt(sc.broadcast(bitmap), bits, sc.broadcast(buckets)), _DEALT)
    listed = spark.createDataFrame([(n, p, s) for (n, p), s in buckets.items()], schema(n_bytes=LONG, print=LONG, salts=INT))
    place = (segments.join(large.select("uid", "print"), "uid").join(F.broadcast(listed), ["n_bytes", "print"], "left")
             .withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int")))
    run = ["n_bytes", "print", "salt", "seg"]
    compared = scratch.table("compared", dealt.union(place.select(*_DEALT.names)).repartition(*run).sortWithinPartitions(*run, "uid")
                             .mapInArrow(_compared, _COMPARED).withColumn("place", F.monotonically_increasing_id()))
    scratch.drop("huge", "large", "repeated")
    if buckets:
        heads = ["n_bytes", "print", "label", "seg"]
        unlike = (compared.filter(F.col("part").isNotNull()).select(*heads, "part").repartition(*heads).sortWithinPartitions(*heads)
                  .mapInArrow(_unlike, schema(label=STRING)).limit(1).collect())
        if unlike:
            raise AssertionError(f"different texts of one SHA-256: {unlike[0].label}")

    # A text of several segments is equal to the first one if all of them are.
    several = (compared.filter("segs > 1").groupBy("uid", "doc_id", "n_bytes", "print", "salt", "salts", "sha")
               .agg(F.bool_and("same").alias("same"), F.max(F.when(F.col("same"), F.col("label"))).alias("label"), F.min("place").alias("place"))
               .withColumn("label", F.when(F.col("same"), F.col("label")).otherwise(F.col("sha"))))
    names = ["doc_id", "n_bytes", "print", "salt", "salts", "sha", "label", "place"]
    members_ = reduce(DataFrame.union, (compared.filter("segs = 1").select(*names), several.select(*names)))
    of = ["n_bytes", "print", "label"]
    best = (members_.groupBy(*of).agg(F.max(F.struct("doc_id", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"), F.max("salts").alias("salts"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    return members_.drop("salts").join(best, [*of, "salt"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("keep.place")).alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read_table(spark, sf_dir, "documents"))
