"""Quality classifier: an interpolated modified Kneser-Ney model of character
4-grams, trained on trusted text, gives each document a perplexity; a document
is rejected above its language's quantile of trusted perplexities.

Counts never leave Spark. Documents are dealt to bundles; a bundle first lists
its distinct 4-grams with their counts in trusted text. Counts of all bundles
are summed by 4-gram, the Kneser-Ney tables follow from them by grouped counts,
and the probabilities return to the bundles by a join on the 4-gram, in as many
shards as the session has shuffle partitions. A bundle then scores its texts
against its own dictionary. The text is shuffled twice, a 4-gram once for each
bundle that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, INT, LONG, STRING, Scratch, packed, read_table, schema, whole

ORDER = 4
START = "\x02" * (ORDER - 1)
OTHER = 0xFFFE  # code points beyond 16 bits count as one symbol
SYMBOLS = 1 << 16
CHUNK_CHARS = 1 << 19
#: Trusted perplexities above this quantile set a language's threshold,
#: widened by MARGIN; PRIOR symbols of the language's mean steady short texts.
QUANTILE, MARGIN, PRIOR = 0.995, 1.1, 100.0
LANGUAGES = 10_000  # rows of a table by language that may be broadcast


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram key of each symbol, symbols of each text), keys in text order."""
    joined = "".join(START + t for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code > 0xFFFF, np.uint32(OTHER), code).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = ORDER - 1
    key = (code[:-3] << np.uint64(48)) | (code[1:-2] << np.uint64(32)) | (code[2:-1] << np.uint64(16)) | code[3:]
    inside = np.ones(len(code), bool)
    at = np.concatenate([[0], np.cumsum(size + pad)])[:-1]
    for i in range(pad):
        inside[at + i] = False
    return key[inside[pad:]], size


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters."""
    a = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_CHARS:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


class _Counts:
    """Distinct keys with counts, folded together now and then."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > 4_000_000 + len(self.keys):
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        counts = np.concatenate([self.counts, *(c for _, c in self.held)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.held, self.size = [], 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bundle, kind, rows) of each run of equal values, in order."""
    for batch in batches:
        if batch.num_rows:
            bundle, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bundle", "kind"))
            cut = np.flatnonzero(np.concatenate([[True], (bundle[1:] != bundle[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield int(bundle[a]), int(kind[a]), batch.slice(a, b - a)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bundle's distinct 4-grams with their counts in trusted text."""
    def rows(bundle, counts):
        counts.fold()
        for a in range(0, len(counts.keys), 1 << 16):
            k = counts.keys[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), bundle, np.int32)), pa.array(k.view(np.int64)), pa.array(counts.counts[a:a + (1 << 16)])],
                                             ["bundle", "gram", "n"])

    now, counts, trusted = None, _Counts(), set()
    for bundle, kind, part in _runs(batches):
        if bundle != now:
            if now is not None:
                yield from rows(now, counts)
            now, counts, trusted = bundle, _Counts(), set()
        if kind == 0:
            trusted.update(part.column("doc_id").to_pylist())
            continue
        texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
        for a, b in pieces(texts):
            keys, size = grams(texts[a:b])
            good = np.repeat(np.fromiter((i in trusted for i in ids[a:b]), bool, b - a), size)
            for k, weight in ((keys[good], 1), (keys[~good], 0)):
                if len(k):
                    k, c = np.unique(k, return_counts=True)
                    counts.add(k, c * weight)
    if now is not None:
        yield from rows(now, counts)


class _Dictionary:
    """Log probabilities by key: a hashed slot first, sorted keys where two
    keys share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(len(keys) * 4).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held, table = None, [], None
    for bundle, kind, part in _runs(batches):
        if bundle != now:
            now, held, table = bundle, [], None
        if kind == 0:
            held.append((part.column("gram").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), part.column("lp").to_numpy(zero_copy_only=False)))
            continue
        if table is None and held:
            table = _Dictionary(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
            held = []
        texts = part.column("text").to_pylist()
        total, length = [], []
        for a, b in pieces(texts):
            keys, size = grams(texts[a:b])
            end = np.cumsum(size)
            running = np.concatenate([[0.0], np.cumsum(table(keys))]) if len(keys) else np.zeros(1)
            total.append(running[end - size] - running[end])
            length.append(size)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("text_hash"), pa.array(np.concatenate(length)), pa.array(np.concatenate(total))],
                                         ["doc_id", "lang", "text_hash", "n_symbols", "nll"])


def _level(counts: DataFrame, below: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """Probability p of each wanted key (long) by interpolated modified
    Kneser-Ney from ``counts`` (key, n) and the probabilities of the keys
    without their first symbol; without ``below`` the base is uniform."""
    of = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    y = of.n1 / (of.n1 + 2 * of.n2) if of.n1 else 0.5
    ratio = [(i + 1) * y * nxt / cur if cur else 0.0 for i, cur, nxt in ((1, of.n1, of.n2), (2, of.n2, of.n3), (3, of.n3, of.n4))]
    d1, d2, d3 = (min(max(i - r, 0.1 * i), 0.95 * i) for i, r in zip((1, 2, 3), ratio))
    n = F.col("n")
    discount = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    context = F.expr("shiftrightunsigned(key, 16)")
    of_context = (counts.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.sum(discount).alias("taken")))
    if below is None:
        one = of_context.agg(F.sum("all").alias("all"), F.sum("taken").alias("taken"))
        total = one.first()
        all_, taken = float(total["all"] or 0), float(total["taken"] or 0)
        known = wanted.join(counts, "key", "left")
        if not all_:
            return known.select("key", F.lit(1.0 / SYMBOLS).alias("p"))
        return known.select("key", ((F.coalesce(n - discount, F.lit(0.0)) + taken / SYMBOLS) / all_).alias("p"))
    return (wanted.join(counts, "key", "left").withColumn("context", context).join(of_context, "context", "left")
            .withColumn("low", F.col("key").bitwiseAND(F.col("mask")))
            .join(below.select(F.col("key").alias("low"), F.col("p").alias("q")), "low")
            .select("key", F.when(F.col("all").isNull(), F.col("q"))
                    .otherwise((F.coalesce(n - discount, F.lit(0.0)) + F.col("taken") * F.col("q")) / F.col("all")).alias("p")))


def gram_probabilities(scratch: Scratch, requests: DataFrame) -> DataFrame:
    """``requests`` (gram, n: count in trusted text, 0 where only asked for)
    -> (key, p) for each distinct gram."""
    top = scratch.table("grams", requests.groupBy(F.col("gram").alias("key")).agg(F.sum("n").alias("n")))
    counts, wanted = [top.filter("n > 0")], [top.select("key")]
    masks = [0xFFFF_FFFF_FFFF, 0xFFFF_FFFF, 0xFFFF]
    for mask in masks:  # lower orders count the distinct symbols before them
        low = F.col("key").bitwiseAND(F.lit(mask)).alias("key")
        counts.append(counts[-1].groupBy(low).agg(F.count("*").alias("n")))
        wanted.append(wanted[-1].select(low).distinct())
    p = None
    for i in (3, 2, 1, 0):
        p = _level(counts[i], p, wanted[i] if i == 3 else wanted[i].withColumn("mask", F.lit(masks[i])))
        if i:
            p = scratch.table(f"order{ORDER - i}", p)
    return p


def _bundle(n: int) -> Column:
    return F.pmod(F.hash(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(n)).cast("int").alias("bundle")


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents as a table: doc_id, lang, text_hash, n_symbols,
    perplexity (of smoothed length), threshold of its language, rejected.

    ``labels`` (doc_id, quality) marks trusted text by quality 1. Null and
    empty texts have no symbols and are rejected. A null lang counts as a
    language of its own; a language without trusted text takes the threshold
    over all languages. Without any trusted text nothing but empty texts is
    rejected. Repeated rows are each scored; columns other than doc_id, text
    and lang are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), whole("text").alias("text"))
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    dealt = (trusted.withColumn("text", F.lit("")).select(_bundle(n), F.lit(0).alias("kind"), "doc_id", "text")
             .union(docs.select(_bundle(n), F.lit(1), "doc_id", "text"))
             .repartition(n, "bundle").sortWithinPartitions("bundle", "kind"))
    requests = scratch.table("requests", dealt.mapInArrow(_count, schema(bundle=INT, gram=LONG, n=LONG)))
    p = gram_probabilities(scratch, requests.select("gram", "n"))
    words = requests.select("bundle", F.col("gram").alias("key")).join(p, "key").select("bundle", F.col("key").alias("gram"), F.log("p").alias("lp"))
    empty = {"gram": LONG, "lp": DOUBLE, "doc_id": LONG, "lang": STRING, "text": STRING, "text_hash": LONG}
    side = [F.lit(None).cast(t).alias(c) for c, t in empty.items()]
    rows = (words.select("bundle", F.lit(0).alias("kind"), "gram", "lp", *side[2:])
            .union(docs.select(_bundle(n), F.lit(1), *side[:2], "doc_id", "lang", "text", F.xxhash64("text")))
            .repartition(n, "bundle").sortWithinPartitions("bundle", "kind"))
    scores = scratch.table("scores", rows.mapInArrow(_score, schema(doc_id=LONG, lang=STRING, text_hash=LONG, n_symbols=LONG, nll=DOUBLE)))
    scratch.drop("requests", "grams", "order1", "order2", "order3")
    known = scores.join(trusted, "doc_id", "left_semi").filter("n_symbols > 0")
    mean = scratch.table("means", known.groupBy("lang").agg((F.sum("nll") / F.sum("n_symbols")).alias("mean")))
    few = mean.count() <= LANGUAGES  # then the scores stay where they are and quantile sketches are merged from partial ones
    by_language = F.broadcast if few else lambda rows: rows
    overall = known.agg((F.sum("nll") / F.sum("n_symbols")).alias("mean")).first()["mean"] or 0.0

    def steady(rows: DataFrame) -> DataFrame:
        return (rows.join(by_language(mean), "lang", "left")
                .withColumn("perplexity", F.exp((F.col("nll") + PRIOR * F.coalesce("mean", F.lit(overall))) / (F.col("n_symbols") + PRIOR))))

    cut = F.percentile_approx("perplexity", QUANTILE, 10_000) * MARGIN
    limits = scratch.table("limits", steady(known).groupBy("lang").agg(cut.alias("threshold")))
    every = limits.agg(F.max("threshold")).first()[0]
    return (steady(scores).join(by_language(limits), "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
            .withColumn("rejected", (F.col("n_symbols") == 0) | F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)))
            .select("doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "text_hash", "n_symbols", "perplexity", "threshold", "rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns, whatever their names) that the
    classifier keeps. Null and empty texts go; repeated rows share a decision;
    long texts are judged whole; empty input gives no rows."""
    bad = perplexities(docs, labels).filter("rejected").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = packed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(whole("text")))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (perplexities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
            .select("doc_id", "lang", "n_symbols", "perplexity", "threshold", F.col("rejected").cast("int").alias("rejected")))
