"""Toxicity: a counterfactual-regularised linear classifier.

Features are a text's words and the beginnings of its words (3 to 6 letters);
vocabulary and weights come from a bounded sample of the labelled training rows
(SAMPLE). For every sampled text counterfactual copies are made: one that names
an identity group names other groups instead, one that names none is given two
groups of one kind in turn. The fit penalises any change of score between
the two copies, so that the mere mention of a group moves no score. Scoring is
one pass over the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, INT, LONG, STRING, Scratch, read_table, schema

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
FOLDS, HELD_OUT = 5, 0
#: Features kept, and labelled rows sampled for the fit (lowest hashes of doc_id).
VOCABULARY, SAMPLE = 2000, 20_000
MIN_ROWS = 5
RIDGE, COUNTERFACTUAL, STEPS = 1e-3, 1.0, 40

# Terms that name groups of people; the terms of one line are
# swapped for each other.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "inmigrantes"),
)
_GROUP = {term: group for group in IDENTITY for term in group}


def features(words: set[str]) -> set[str]:
    """Feature names of a text's distinct lower-case words."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(f"{w[:n]}~" for w in words if len(w) > n)
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


SLICE = 64  # texts whose feature names a task holds at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        words = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(words, pa.list_(pa.string())), pa.array([sorted(features(set(w))) for w in words], pa.list_(pa.string()))], ["doc_id", "toxic", "words", "features"])


def vocabulary(sample: DataFrame) -> list[str]:
    """The VOCABULARY features that tell the labels apart most (chi-square) in
    the sample (toxic, features), and the identity terms with their beginnings."""
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"] or 0, total["t"] or 0
    terms = sorted({f for group in IDENTITY for term in group for f in features({term})})
    if not 0 < t < n:
        return terms
    counts = sample.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic"))
    off = F.col("toxic") - F.col("rows") * F.lit(t / n)
    spread = off * off / (F.col("rows") * F.lit(t / n * (1 - t / n)) * (1 - F.col("rows") / F.lit(n + 1.0)))
    top = counts.filter(F.col("rows") >= MIN_ROWS).withColumn("chi", spread).orderBy(F.desc("chi"), "feature").limit(VOCABULARY).select("feature").collect()
    chosen = [r["feature"] for r in top]
    return chosen + [x for x in terms if x not in set(chosen)]


def counterfactuals(words: set[str], turn: int) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that differ in the identity groups they name."""
    named = words & _GROUP.keys()
    if named:  # all named terms move on by one and by two
        rest = words - named
        return [(words, rest | {_GROUP[w][(_GROUP[w].index(w) + k) % len(_GROUP[w])] for w in named}) for k in (1, 2)]
    pairs = []
    for k in (0, 1):
        group = IDENTITY[(2 * turn + k) % len(IDENTITY)]
        at = turn // len(IDENTITY)
        pairs.append((words | {group[at % len(group)]}, words | {group[(at + 1) % len(group)]}))
    return pairs


def _vectors(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = index.value

        def at(names):
            return sorted(place[f] for f in names if f in place)
        for batch in _slices(batches):
            first, second = [], []
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist()):
                pairs = counterfactuals(set(words), doc_id)
                first.append([at(features(a)) for a, _ in pairs])
                second.append([at(features(b)) for _, b in pairs])
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([at(f) for f in batch.column("features").to_pylist()], pa.list_(pa.int32())), pa.array(first, kind), pa.array(second, kind)], ["toxic", "at", "first", "second"])
    return run


def fit(rows: list, size: int, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model: log loss + ridge + ``penalty`` x
    mean squared change of score between counterfactual copies, by
    conjugate-gradient Newton steps."""
    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), np.int64)

    y = np.array([r["toxic"] for r in rows], float)
    at = [r["at"] for r in rows]
    row, col = sparse(at)
    first = [s for r in rows for s in r["first"]]
    second = [s for r in rows for s in r["second"]]
    frow, fcol = sparse(first)
    srow, scol = sparse(second)
    m, k = len(y), len(second)

    def forward(w, b):
        return np.bincount(row, w[col], minlength=m) + b

    def change(w):
        return np.bincount(frow, w[fcol], minlength=k) - np.bincount(srow, w[scol], minlength=k)

    def back(r, c):
        g = np.bincount(col, r[row], minlength=size)
        if k:
            g += np.bincount(fcol, c[frow], minlength=size) - np.bincount(scol, c[srow], minlength=size)
        return g

    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / m
    lam = penalty / max(1, k)
    w, b = np.zeros(size), 0.0
    for _ in range(STEPS):
        z = forward(w, b)
        p = 1 / (1 + np.exp(-z))
        r = weight * (p - y)
        g, gb = back(r, 2 * lam * change(w)) + RIDGE * w, r.sum()
        if np.sqrt((g * g).sum() + gb * gb) < 1e-8:
            break
        h = weight * np.maximum(p * (1 - p), 1e-6)

        def times(v, vb):
            u = h * forward(v, vb)
            return back(u, 2 * lam * change(v)) + RIDGE * v, u.sum() + 1e-9 * vb

        d, db, res, resb = np.zeros(size), 0.0, -g, -gb
        q, qb = res.copy(), resb
        rs = (res * res).sum() + resb * resb
        for _ in range(50):
            hq, hqb = times(q, qb)
            a = rs / max((q * hq).sum() + qb * hqb, 1e-30)
            d, db, res, resb = d + a * q, db + a * qb, res - a * hq, resb - a * hqb
            new = (res * res).sum() + resb * resb
            if new < 1e-16:
                break
            q, qb, rs = res + new / rs * q, resb + new / rs * qb, new
        w, b = w + d, b + db
    return w, b


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, starts, offset = model.value
        lengths = sorted({len(s) for s in starts})
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                z = offset + sum(map(whole.__getitem__, words & whole.keys()))
                for n in lengths:
                    z += sum(map(starts.__getitem__, {w[:n] for w in words if len(w) > n} & starts.keys()))
                out.append(1 / (1 + np.exp(-z)))
            score = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[list, list[str]]:
    """(vectors of the sampled labelled rows, feature names). Only the sampled
    ids reach the driver before (SAMPLE at most); their texts are found in one
    pass, and what is written and shuffled is their features alone."""
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
             .filter(~_held(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    lowest = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], schema(doc_id=LONG, toxic=INT)))
    # One text of a repeated id: the smallest, found before anything is moved.
    texts = docs.select("doc_id", "text").join(lowest, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    words = T.ArrayType(STRING)
    sample = scratch.table("sample", texts.mapInArrow(_features, schema(doc_id=LONG, toxic=INT, words=words, features=words)))
    names = vocabulary(sample)
    place = {f: i for i, f in enumerate(names)}
    at = T.ArrayType(INT)
    rows = sample.mapInArrow(_vectors(spark.sparkContext.broadcast(place)), schema(toxic=INT, at=at, first=T.ArrayType(at), second=T.ArrayType(at))).collect()
    scratch.drop("sample")
    return rows, names


def _held(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic), any further columns
    -> doc_id, held_out, score, predicted, one row per row of ``docs``.

    Rows whose crc32 of the doc_id's text is a multiple of FOLDS are held out:
    their labels are never read. Null labels don't train; of an id's labels the
    highest counts, of its texts the smallest. Null and empty texts have no
    feature and score as the offset says; a null doc_id trains nothing and
    counts as not held out. Without both labels every score is the share of the
    one label seen (0 without any). Repeated rows are each scored. A task holds
    one Arrow batch of whole texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, terms = training_rows(docs, labels, scratch)
    seen = {r["toxic"] for r in rows}
    w, b = fit(rows, len(terms)) if len(seen) == 2 else (np.zeros(len(terms)), 20.0 if seen == {1} else -20.0)
    weight = {f: float(x) for f, x in zip(terms, w) if x}
    model = spark.sparkContext.broadcast(({f: x for f, x in weight.items() if f[-1] != "~"}, {f[:-1]: x for f, x in weight.items() if f[-1] == "~"}, float(b)))
    scored = T.StructType([T.StructField("doc_id", LONG), T.StructField("held_out", T.BooleanType()), T.StructField("score", DOUBLE), T.StructField("predicted", INT)])
    return docs.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), scored)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
