"""Nearest neighbours by a block matrix join, exact.

Vectors are packed into blocks of about BLOCK rows, each with int8 codes, one
scale per vector and the norm of what quantisation lost. Every block of queries
meets every block of candidates; a tile of int8 products bounds each inner
product from both sides,

    |<u, v> - s_u s_v <q_u, q_v>| <= |s_u q_u| |v - s_v q_v| + |u - s_u q_u| |v|,

so a candidate whose upper bound is below the K-th largest lower bound of its
query cannot be among the K nearest. Survivors are recomputed in double
precision, and the best of each tile are merged by heaps, in a tree over the
candidate blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BINARY, DOUBLE, INT, LONG, Scratch, read_table, schema

TOP, EVERY, BLOCK, MERGE = 20, 20, 2048, 32
#: Components whose int8 products sum exactly in float32 (127^2 x 1024 < 2^24).
EXACT = 1024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the remainders) of the rows of v."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(v - codes * scale[:, None], axis=1)


_PACKED = schema(dim=INT, block=INT, query=INT, n=INT, ids=BINARY, vectors=BINARY)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of up to BLOCK rows of a block (rows come sorted
    by dim, query and block)."""
    def row(key, ids, vectors):
        v = np.concatenate(vectors)
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in (*key, len(v))), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                                          ["dim", "query", "block", "n", "ids", "vectors"]).select(_PACKED.names)

    now, ids, vectors, size = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "query", "block")])
        cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            key = tuple(keys[:, a].tolist())
            if now != key or size + b - a > 2 * BLOCK:
                if size:
                    yield row(now, ids, vectors)
                now, ids, vectors, size = key, [], [], 0
            part = batch.slice(a, b - a)
            ids.append(part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
            vectors.append(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, key[0]))
            size += b - a
    if size:
        yield row(now, ids, vectors)


def _tile(k: int):
    def best(q_ids, q, c_ids, c) -> Iterator[tuple[int, list, list]]:
        # Equal vectors once: only the k + 1 smallest ids of each can be used.
        c, inverse = np.unique(c, axis=0, return_inverse=True)
        order = np.lexsort((c_ids, inverse.ravel()))
        c_ids, inverse = c_ids[order], inverse.ravel()[order]
        fresh = np.concatenate([[True], (c_ids[1:] != c_ids[:-1]) | (inverse[1:] != inverse[:-1])])
        c_ids, inverse = c_ids[fresh], inverse[fresh]
        start = np.searchsorted(inverse, np.arange(len(c)))
        count = np.minimum(np.diff(np.append(start, len(inverse))), k + 1)
        # Several vectors of one id are one candidate: bounds count ids then.
        by_id = np.argsort(c_ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], c_ids[by_id][1:] != c_ids[by_id][:-1]]))
        repeats = len(first) < len(c_ids)
        qc, qs, qe = quantise(q)
        cc, cs, ce = quantise(c)
        product = np.zeros((len(q), len(c)))
        for a in range(0, q.shape[1], EXACT):  # whole numbers in both types, so the sum has no rounding at any dim
            product += qc[:, a:a + EXACT].astype(np.float32) @ cc[:, a:a + EXACT].astype(np.float32).T
        middle = product * (qs[:, None] * cs[None, :])
        slack = np.linalg.norm(qc * qs[:, None], axis=1)[:, None] * ce[None, :] + qe[:, None] * np.linalg.norm(c, axis=1)[None, :]
        slack = slack * (1 + 1e-6) + 1e-9 * (np.abs(middle) + 1)
        low = middle - slack
        if repeats:
            low = np.maximum.reduceat(low[:, inverse[by_id]], first, axis=1)
        n = low.shape[1]
        take = min(k + 1, n)  # one of them may be the query itself
        bar = np.partition(low, n - take, axis=1)[:, n - take] if n > take else np.full(len(q), -np.inf)
        rows, cols = np.nonzero(middle + slack >= bar[:, None])
        score = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 15):
            score[a:a + (1 << 15)] = (q[rows[a:a + (1 << 15)]] * c[cols[a:a + (1 << 15)]]).sum(axis=1)
        edge = np.searchsorted(rows, np.arange(len(q) + 1))
        for i in range(len(q)):
            s, at = score[edge[i]:edge[i + 1]], cols[edge[i]:edge[i + 1]]
            if len(s) > take and not repeats:  # sums in any order differ by less than this margin
                keep = s >= np.partition(s, len(s) - take)[len(s) - take] - 1e-12 * (1 + np.abs(s).max())
                s, at = s[keep], at[keep]
            s = np.array([math.fsum(x) for x in (q[i] * c[at]).tolist()])
            by = np.argsort(-s, kind="stable")
            s, at = s[by], at[by]
            n = count[at]
            place = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
            s, ids = np.repeat(s, n), c_ids[place]
            own = ids != q_ids[i]
            s, ids = s[own], ids[own]
            by = np.lexsort((ids, -s))
            if repeats:  # the best score of each id
                by = by[np.sort(np.unique(ids[by], return_index=True)[1])]
            by = by[:k]
            yield int(q_ids[i]), s[by].tolist(), ids[by].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in ("dim", "block", "q_ids", "q_vectors", "ids", "vectors")}
                q_ids, c_ids = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["ids"], np.int64)
                q = np.frombuffer(x["q_vectors"]).reshape(-1, x["dim"])
                c = np.frombuffer(x["vectors"]).reshape(-1, x["dim"])
                found = list(best(q_ids, q, c_ids, c))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([x["block"]] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))],
                                                 ["query_id", "block", "scores", "ids"])
    return run


def _merge(k: int, final: bool):
    """Best k of the sorted lists of each (query, part), by a heap merge; rows
    come sorted by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, held):
            seen, out = set(), []
            for s, i in heapq.merge(*held):
                if i not in seen:
                    seen.add(i)
                    out.append((-s, i))
                    if len(out) == k:
                        break
            return key, out

        def rows(found):
            if final:
                flat = [(q[0], r + 1, i, s) for q, out in found for r, (s, i) in enumerate(out)]
                cols = list(zip(*flat)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])
            return pa.RecordBatch.from_arrays([pa.array([q[0] for q, _ in found], pa.int64()), pa.array([q[1] for q, _ in found], pa.int32()), pa.array([[s for s, _ in o] for _, o in found], pa.list_(pa.float64())), pa.array([[i for _, i in o] for _, o in found], pa.list_(pa.int64()))],
                                              ["query_id", "block", "scores", "ids"])

        now, held, found = None, [], []
        for batch in batches:
            for q, part, s, i in zip(*(batch.column(c).to_pylist() for c in ("query_id", "part", "scores", "ids"))):
                if (q, part) != now:
                    if now is not None:
                        found.append(done(now, held))
                    if len(found) >= 4096:
                        yield rows(found)
                        found = []
                    now, held = (q, part), []
                held.append([(-a, b) for a, b in zip(s, i)])
        if now is not None:
            found.append(done(now, held))
        if found:
            yield rows(found)
    return run


def nearest(vectors: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score for each
    row that ``is_query`` (a condition) selects, by largest inner product, ties
    to the smaller vec_id, among all other rows.

    Rows whose vec_id or vector is null, or whose vector is empty, zero or
    holds a null or non-finite component, take no part. Vectors are compared
    with those of their own length. Rows that repeat a vec_id count as one
    candidate (its best score) and one query (its smallest vector); none is its
    own neighbour. Empty
    input gives no rows; further columns are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    v = F.col("embedding").cast("array<double>")
    clean = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("vec_id is not null and size(v) > 0")
             .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("v", lambda x: x != 0.0))
             .withColumn("dim", F.size("v")))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in clean.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).collect()}
    found = None
    for dim, (n, q) in sorted(sizes.items()):
        if not q:
            continue
        n_blocks, q_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(q / BLOCK))
        block = lambda m, kind: F.pmod(F.xxhash64("vec_id", F.lit(kind)), F.lit(m)).cast("int")
        own = clean.filter(F.col("dim") == dim)
        both = (own.select("dim", block(n_blocks, 0).alias("block"), F.lit(0).alias("query"), "vec_id", "v")
                .union(own.filter("query").groupBy("dim", "vec_id").agg(F.min("v").alias("v")).select("dim", block(q_blocks, 1), F.lit(1), "vec_id", "v")))
        packed = scratch.table(f"packed{dim}", both.repartition("query", "block").sortWithinPartitions("dim", "query", "block").mapInArrow(_pack, _PACKED))
        asked = packed.filter("query = 1").select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        # Each block of queries goes to each block of candidates; both are of bounded size.
        tiles = packed.filter("query = 0").select("dim", "block", "ids", "vectors").join(asked, "block")
        level = tiles.select("dim", "block", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(_tile(k), "query_id long, block int, scores array<double>, ids array<long>")
        parts = n_blocks
        while parts > MERGE:
            parts = math.ceil(parts / MERGE)
            level = (level.withColumn("part", F.floor(F.col("block") / MERGE).cast("int")).repartition("query_id", "part").sortWithinPartitions("query_id", "part")
                     .mapInArrow(_merge(k, False), "query_id long, block int, scores array<double>, ids array<long>"))
        level = (level.withColumn("part", F.lit(0)).repartition("query_id").sortWithinPartitions("query_id")
                 .mapInArrow(_merge(k, True), schema(query_id=LONG, rank=INT, vec_id=LONG, score=DOUBLE)))
        found = level if found is None else found.union(level)
    return found if found is not None else spark.createDataFrame([], schema(query_id=LONG, rank=INT, vec_id=LONG, score=DOUBLE))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
