"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the text, sketches of parts merge by union, and overlap and
containment of very unequal texts are estimated without bias. A fingerprint is
the text ``<xxh64 of the text>:<shingles>:<base64 of the kept hashes, six bytes
each, ascending>``; equal texts have equal fingerprints.

``next_documents`` pairs every document with the next one by doc_id in one
shuffle: documents go to ranges of doc_id, and the first document of a range is
sent along to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOUBLE, INT, LONG, STRING, prepare, read_table, schema, whole
from .shingles import chunks, shingles, text_column

#: Share of the hash range that is kept.
FRACTION = 0.25
BITS = 48


def sketches(texts: list[str], fraction: float = FRACTION) -> tuple[list[np.ndarray], list[int]]:
    """(kept 48-bit hashes, ascending and distinct; words) of each text."""
    limit = np.uint64(min(int(fraction * 2.0 ** 64), 2 ** 64 - 1))
    kept, words = [], []
    data, offsets = text_column(pa.array(texts, pa.large_string()))
    for a, b in chunks(offsets):
        hashes, row, count = shingles(data, offsets[a:b + 1])
        low = hashes < limit
        hashes, row = hashes[low] >> np.uint64(64 - BITS), row[low]
        cut = np.searchsorted(row, np.arange(b - a + 1))
        kept += [np.unique(hashes[cut[i]:cut[i + 1]]) for i in range(b - a)]
        words += count.tolist()
    return kept, words


def fingerprint(text: str, kept: np.ndarray, words: int) -> str:
    raw = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}:{max(words - 4, min(words, 1))}:{base64.b64encode(raw).decode()}"


def kept_hashes(print_: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(print_.split(":")[2]), np.uint8).reshape(-1, 6).astype(np.uint64)
    return (raw << (np.uint64(8) * np.arange(5, -1, -1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Estimated Jaccard similarity; when neither text keeps a hash, whether
    the texts are the same."""
    if not len(a) and not len(b):
        return float(same)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of a's shingles that b has; None if a keeps none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else None


def edited(text: str, after: str) -> str:
    """The text whose last half is replaced by the beginning of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


_OUT = schema(doc_id=LONG, n_chars=LONG, edited_sha256=STRING, fingerprint=STRING, edited_fingerprint=STRING, near_edited=DOUBLE, near_next=DOUBLE)
BATCH_CHARS = 1 << 20


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and doc_id; a range ends with the first document of
    the next one (copy true), which is only compared against."""
    def finish(rows):  # the last one is only the next document of its predecessor
        ids, texts, copy, range_ = ([r[i] for r in rows] for i in range(4))
        own = [i for i in range(len(rows) - 1) if not copy[i]]
        if not own:
            return
        for i in own:
            if range_[i] != range_[i + 1]:
                raise AssertionError("a range without its end")
        new = [edited(texts[i], texts[i + 1]) for i in own]
        kept, words = sketches(texts)
        kept_new, words_new = sketches(new)
        cols: list[list] = [[] for _ in _OUT]
        for k, i in enumerate(own):
            row = (ids[i], len(texts[i]), hashlib.sha256(new[k].encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(texts[i], kept[i], words[i]), fingerprint(new[k], kept_new[k], words_new[k]),
                   likeness(kept[i], kept_new[k], texts[i] == new[k]), likeness(kept[i], kept[i + 1], texts[i] == texts[i + 1]))
            for c, v in zip(cols, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], _OUT.names)

    rows, size = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "range"))):
            rows.append(r)
            size += len(r[1])
            if size > BATCH_CHARS and len(rows) > 1:
                yield from finish(rows)
                rows, size = rows[-1:], len(rows[-1][1])
    if rows:
        yield from finish(rows)


def _place(marks: list[float], a: int, b: int) -> Column:
    """Number of marks up to doc_id, by halving; 0 for null."""
    if a == b:
        return F.lit(a)
    half = (a + b) // 2
    return F.when(F.col("doc_id") >= F.lit(marks[half]), _place(marks, half + 1, b)).otherwise(_place(marks, a, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any further columns) -> the columns of _OUT, one
    row per input row. Next is by ascending doc_id, nulls first, equal ids by
    text; after the last document comes the first, so a single document is its
    own next.

    Null texts count as empty. Empty input gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text").cast("string")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges by quantiles of doc_id (n numbers, whatever the input).
    marks = sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)))
    rows = docs.withColumn("range", _place(marks, 0, len(marks)).cast("int"))
    lowest = rows.groupBy("range").agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("low")).orderBy("range").collect()
    if not lowest:
        return spark.createDataFrame([], _OUT)
    before = {r["range"]: lowest[i - 1]["range"] for i, r in enumerate(lowest)}
    low = spark.createDataFrame([(r["range"], before[r["range"]], None if r["nulls"] else r["low"]) for r in lowest], schema(range=INT, before=INT, low=LONG))
    heads = (rows.join(F.broadcast(low), "range").filter(F.col("doc_id").eqNullSafe(F.col("low")))
             .groupBy("before").agg(F.min("text").alias("text")))
    dealt = (rows.select("range", F.lit(False).alias("copy"), "doc_id", "text")
             .union(heads.select("before", F.lit(True), F.lit(None).cast("long"), "text"))
             .repartitionByRange(n, "range").sortWithinPartitions("range", "copy", F.col("doc_id").asc_nulls_first(), "text"))
    return dealt.mapInArrow(_compare, _OUT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
