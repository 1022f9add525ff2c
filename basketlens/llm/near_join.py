"""N-gram Jaccard self-join of documents, exact at a similarity of 3/4, as
components, by set-relation skipping.

A document's set is its distinct five-word shingles (see ``shingles``); two
documents link when 100 * |A & B| >= 75 * |A | B|. Equal sets form one class
(a 64-bit digest of the set and its size), so copies are never paired.

1. *Order.* A fixed-size table of shingle counts over all documents (2^24
   cells) gives each shingle a frequency level; shingles are ordered by level,
   then hash. Any fixed order keeps the join exact; this one puts passages that
   many documents share behind the rare shingles, out of the index.
2. *Index.* Each class lists its first n - ceil(3n/4) + 1 shingles with their
   positions; linked classes share at least one. Lists are sorted by set size;
   entries without a neighbour of a fitting size are skipped.
3. *Answers of similar sets.* Every class is checked against the leaders (the
   smallest positions) that it meets in most of its lists. Verified links merge classes; whatever lies
   in one component needs no further answer.
4. *Remaining pairs.* Lists are read again by blocks of one component and one
   range of sizes: block pairs of one component, of unfitting sizes or of too
   late positions are skipped whole. A pair's shared index shingles bound its
   overlap; only pairs that can still reach the threshold are verified.

Results are whole: no list, class or candidate is capped. Shingles are compared
as 64-bit hashes (60 bits in the index, which only proposes pairs).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, INT, LONG, Scratch, components, packed, read_table, schema
from .shingles import mix, shingle_sets, shingles, text_column, chunks

CELL_BITS = 24
BLOCK = 1 << 16
BLOCK_ENTRIES = 256
LEADERS = 3  # of a list's run of sizes
ANSWERS = 4  # leaders a set is checked against at first


def prefix_length(n):
    """Index entries of a set of n shingles: n - ceil(3n/4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def needed_overlap(n, m):
    """Least |A & B| with 100 |A & B| >= 75 |A | B|."""
    return (3 * (n + m) + 6) // 7


def digest(s: np.ndarray) -> int:
    """64-bit digest of a set of hashes, as a signed integer."""
    x = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(x ^ mix(np.array([len(s)], dtype=np.uint64))).view(np.int64)[0])


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, held, size = np.zeros(1 << CELL_BITS, np.uint32), [], 0
    shift = np.uint64(64 - CELL_BITS)

    def fold():
        np.add.at(cells, np.concatenate(held), np.uint32(1))

    for batch in batches:
        data, offsets = text_column(batch.column(0))
        for a, b in chunks(offsets):
            hashes, _, _ = shingles(data, offsets[a:b + 1])
            held.append((hashes >> shift).astype(np.int64))
            size += len(hashes)
            if size > 1 << 20:
                fold()
                held, size = [], 0
    if held:
        fold()
    for k in range(0, len(cells), BLOCK):
        part = cells[k:k + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()),
                                              "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})


def _sum_cells(frame):
    import pandas as pd
    total = np.zeros(BLOCK, np.uint64)
    for c in frame["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.uint32)
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Level of each cell: 0 up to twice the mean count, then one per doubling
    (15 at most). 16 MB whatever the input, so it may be broadcast."""
    cells = schema(block=INT, counts=BINARY)
    parts = (docs.select("text").mapInArrow(_count_cells, cells)
             .groupBy("block").applyInPandas(_sum_cells, cells).collect())
    counts = {row["block"]: np.frombuffer(zlib.decompress(row["counts"]), np.uint32) for row in parts}
    mean = sum(int(c.sum(dtype=np.uint64)) for c in counts.values()) / (1 << CELL_BITS)
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for k, c in counts.items():
        levels[k * BLOCK:(k + 1) * BLOCK] = np.clip(np.log2(np.maximum(1.0, c / (2 * mean + 8))), 0, 15)
    return levels


def _index(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            size, node, entries = [], [], []
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                d = digest(s) if n else None
                size.append(n)
                node.append(d)
                if not n or d in seen:
                    entries.append(None)
                    continue
                seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()  # entries may then repeat; the list scan drops repeats
                key = (level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(59)) | (s >> np.uint64(5))
                k = prefix_length(n)
                entries.append(np.sort(np.partition(key, k - 1)[:k]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                                              pa.array(entries, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "node", "entries"])
    return run


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists (all rows of a token) from rows sorted by token: each item
    holds one or more lists."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in columns}
        cut = int(np.flatnonzero(now["token"] == now["token"][-1])[0]) if now["token"][0] != now["token"][-1] else 0
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        held = {c: v[cut:] for c, v in now.items()}
    if held is not None:
        yield held


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that share a list with a set of fitting size, with the leaders of
    their run of sizes. Rows come sorted by token, size, node."""
    for x in _lists(batches, ["token", "n", "node", "pos"]):
        token, n, node, pos = x["token"], x["n"], x["node"], x["pos"]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, n, node, pos = token[new], n[new], node[new], pos[new]
        fits = (token[1:] == token[:-1]) & (4 * n[:-1] >= 3 * n[1:])
        keep = np.zeros(len(token), bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        token, n, node, pos = token[keep], n[keep], node[keep], pos[keep]
        if len(token) == 0:
            continue
        leader = np.empty((len(token), LEADERS), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            while a < b:  # a run: sizes up to 4/3 of its first
                end = a + int(np.searchsorted(n[a:b] * 3, n[a] * 4, side="right"))
                leader[a:end] = node[a + np.resize(np.lexsort((node[a:end], pos[a:end]))[:LEADERS], LEADERS)]
                a = end
        leaders = pa.ListArray.from_arrays(pa.array(np.arange(0, leader.size + 1, LEADERS, dtype=np.int32)), pa.array(leader.ravel()))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (token, n, node, pos)), leaders], ["token", "n", "node", "pos", "leaders"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, shared = batch.column("a"), batch.column("b"), []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            shared.append(100 * common >= 75 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(shared, pa.bool_())], ["a", "b", "linked"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    out = schema(a=LONG, b=LONG, linked=T.BooleanType())
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(_verify, out).filter("linked").select("a", "b"))


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of entries of one list that lie in different components and whose
    sizes and positions still allow a link. Blocks hold up to BLOCK_ENTRIES
    entries of one component in order of size; a pair of blocks is skipped by
    component, range of sizes or earliest positions."""
    def pairs(n, node, pos, label):
        order = np.lexsort((n, label))
        n, node, pos, label = n[order], node[order], pos[order], label[order]
        edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
        starts = np.concatenate([np.arange(a, b, BLOCK_ENTRIES) for a, b in zip(edge[:-1], edge[1:])])
        ends = np.minimum(starts + BLOCK_ENTRIES, edge[np.searchsorted(edge, starts, side="right")])
        block = np.repeat(np.arange(len(starts)), ends - starts)
        low, high, of = n[starts], n[ends - 1], label[starts]
        early = np.minimum.reduceat(pos, starts)
        for k in range(len(starts) - 1):
            met = (of != of[k]) & (4 * high >= 3 * low[k]) & (4 * high[k] >= 3 * low)
            met &= np.minimum(high - early, high[k] - early[k]) >= needed_overlap(low, low[k])
            met[:k + 1] = False
            others = np.flatnonzero(met[block])
            for i in range(starts[k], ends[k]) if len(others) else ():
                yield from fit(n, node, pos, i, others)

    def fit(n, node, pos, i, j):
        # At the first index shingle that a pair shares, this is the most it can share.
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        j = j[most >= needed_overlap(n[i], n[j])]
        if len(j):
            first = node[i] < node[j]
            yield (np.where(first, node[i], node[j]), np.where(first, node[j], node[i]),
                   np.where(first, n[i], n[j]), np.where(first, n[j], n[i]))

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "n_a", "n_b"])

    found, size = [], 0
    for x in _lists(batches, ["token", "n", "node", "pos", "label"]):
        cuts = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if (x["label"][a:b] != x["label"][a]).any():
                for f in pairs(*(x[c][a:b] for c in ("n", "node", "pos", "label"))):
                    found.append(f)
                    size += len(f[0])
                    if size > 1 << 16:
                        yield rows(found)
                        found, size = [], 0
    if found:
        yield rows(found)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column("node").to_pylist()
        found = list(shingle_sets(batch.column("text")))
        rows = [(d, s) for d, s in zip(wanted, found) if len(s) and digest(s) == d]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["node", "items"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any further columns) -> doc_id, n_shingles,
    component_id, one row per input row.

    Null or empty texts and texts without words have no shingle, link with
    nothing and are their own component. A null doc_id takes part; it is never
    a component id unless all of its component are null. Repeated rows keep
    their count. Empty input gives no rows. Further columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    levels = spark.sparkContext.broadcast(frequency_levels(docs))
    index = scratch.table("index", docs.mapInArrow(_index(levels), schema(doc_id=LONG, text_hash=LONG, n_shingles=LONG, node=LONG, entries=T.ArrayType(LONG))))
    postings = (index.filter("entries is not null").select(F.col("n_shingles").alias("n"), "node", F.posexplode("entries").alias("pos", "token")))
    entry = schema(token=LONG, n=LONG, node=LONG, pos=LONG, leaders=T.ArrayType(LONG))
    lists = scratch.table("lists", postings.select("token", "n", "node", F.col("pos").cast("long").alias("pos")).repartition("token")
                          .sortWithinPartitions("token", "n", "node").mapInArrow(_scan_lists, entry))

    def linked(name: str, pairs: DataFrame) -> DataFrame:
        """The linking pairs; whole sets are made again, once for each class
        of the pairs, from its first document."""
        pairs = scratch.table(f"{name}-pairs", pairs)
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        chosen = (index.filter("node is not null").join(wanted, "node", "left_semi")
                  .groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("chosen")).select("node", "chosen.*")
                  .withColumnsRenamed({"doc_id": "chosen_id", "text_hash": "chosen_hash"}))
        # By id and text: rows that repeat an id, or have none, meet only their own class.
        sets = scratch.table(f"{name}-sets", docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen_id"]) & (docs["text_hash"] == chosen["chosen_hash"])).select("node", "text")
                             .mapInArrow(_sets, schema(node=LONG, items=BINARY)))
        found = scratch.table(name, verified(pairs, sets).distinct())
        scratch.drop(f"{name}-pairs", f"{name}-sets")
        return found

    # Answers of similar sets: the leaders met in most lists.
    met = (lists.select("node", "n", F.explode(F.array_distinct("leaders")).alias("leader")).filter("node != leader")
           .groupBy("node", "leader").agg(F.count("*").alias("votes"), F.max("n").alias("n")).filter("votes * 20 >= n"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "leader")), False), 1, ANSWERS).alias("best"))
    pairs = (best.select(F.col("node").alias("a"), F.explode("best.leader").alias("b"))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = linked("links", pairs)
    labels = components(scratch, "similar", links)
    # Remaining pairs, by components.
    seen = scratch.table("labelled", lists.select("token", "n", "node", "pos").join(labels, "node", "left")
                         .select("token", "n", "node", "pos", F.coalesce("label", "node").alias("label")))
    met = scratch.table("met", seen.repartition("token").sortWithinPartitions("token", "n", "node")
                        .mapInArrow(_remaining, schema(a=LONG, b=LONG, n_a=LONG, n_b=LONG)).distinct())
    both = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    own = scratch.table("own", index.filter("entries is not null").join(both, "node", "left_semi").groupBy("node").agg(F.first("entries").alias("entries")))
    # Common shingles outside the index follow the earlier of the two index ends.
    rest = (met.join(own.select(F.col("node").alias("a"), F.col("entries").alias("in_a")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("entries").alias("in_b")), "b")
            .filter(F.expr("size(array_intersect(in_a, in_b)) + greatest(n_a + ceil(-n_a / 4), n_b + ceil(-n_b / 4)) >= floor((3 * (n_a + n_b) + 6) / 7)"))
            .select("a", "b"))
    more = linked("more", rest)
    scratch.drop("lists", "labelled", "met", "own")
    labels = components(scratch, "all", links.union(more))
    scratch.drop("links", "more")
    rows = index.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("lowest"))
    return (rows.join(lowest, "label", "left")
            .select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")))


def _orderable(field: T.StructField) -> Column:
    """A column that can be compared: maps and other nested values as JSON."""
    value = F.col("row").getField(field.name)
    return value if isinstance(field.dataType, T.AtomicType) and not isinstance(field.dataType, T.VariantType) else F.to_json(F.struct(value.alias("value")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns, whatever their names) that stay: of
    each component the document with the smallest doc_id, then the smallest text
    hash. A null doc_id counts as one below all others, made from its text. A
    document is a doc_id with a text: different texts of one doc_id are judged
    each for itself, repeated rows of a document leave one row, the smallest.
    Documents without words link with nothing and stay; long texts are compared
    whole; empty input gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63))))
    rows = packed(docs, text=text, own=own, hash=F.xxhash64(text)).withColumn("key", F.xxhash64("own", "hash"))
    ids = rows.select("key", "own", "hash").distinct()
    found = jaccard_components(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    kept = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("own", "hash", "key")).alias("first")).select("first.key")
    return (rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(*map(_orderable, docs.schema))).alias("row"))
            .select("row.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
