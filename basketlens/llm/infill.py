"""Fill-in-the-middle transformation of whole texts.

A text is cut into lines. A Fenwick tree over fixed blocks of its UTF-8 bytes
holds, per block, the number of line ends and of code points; a binary-lifting
descent finds the block of a cut and the code points before it, and the cut is
then located inside that block alone. Prefix, middle and suffix are put
together behind sentinels, either prefix first (psm) or suffix first (spm).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, STRING, prepare, read_table, schema, whole
from .shingles import text_column

BLOCK_BYTES = 4096
BATCH_BYTES = 8 << 20
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
NEWLINE = 10


class LineTree:
    """Fenwick tree over blocks of a text's bytes: line ends (row 0) and code
    points (row 1)."""

    def __init__(self, data: np.ndarray, block: int = BLOCK_BYTES):
        self.data, self.block = data, block
        self.blocks = -(-len(data) // block)
        before = np.zeros((2, self.blocks + 1), np.int64)
        if self.blocks:
            at = np.arange(self.blocks) * block
            np.cumsum(np.add.reduceat(data == NEWLINE, at, dtype=np.int64), out=before[0, 1:])
            np.cumsum(np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64), out=before[1, 1:])
        self.ends, self.chars = (int(x) for x in before[:, -1])
        #: Lines; the last one may lack its line end.
        self.lines = self.ends + int(len(data) > 0 and data[-1] != NEWLINE)
        i = np.arange(self.blocks + 1)
        self.tree = before - before[:, i - (i & -i)]

    def cut(self, lines: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``lines`` lines."""
        if lines <= 0:
            return 0, 0
        if lines > self.ends:
            return len(self.data), self.chars
        at, left, chars = 0, lines, 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            to = at + step
            if to <= self.blocks and self.tree[0, to] < left:
                at, left, chars = to, left - int(self.tree[0, to]), chars + int(self.tree[1, to])
            step >>= 1
        here = self.data[at * self.block:(at + 1) * self.block]
        size = int(np.flatnonzero(here == NEWLINE)[left - 1]) + 1
        return at * self.block + size, chars + int(np.count_nonzero((here[:size] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four keyed 32-bit numbers of a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


_OUT = schema(doc_id=LONG, n=LONG, form=STRING, prefix_chars=LONG, middle_chars=LONG, output=STRING)


def _transform(rate: int, spm_rate: int, seed: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def one(doc_id: int | None, data: np.ndarray) -> tuple:
        raw = data.tobytes()
        tree = LineTree(data)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not raw or p in raw or s in raw or m in raw or h3 % 100 >= rate:
            return doc_id, tree.lines, "plain", None, None, raw
        a, b = sorted((h1 % (tree.lines + 1), h2 % (tree.lines + 1)))
        (to, chars), (end, upto) = tree.cut(a), tree.cut(b)
        prefix, middle, suffix = raw[:to], raw[to:end], raw[end:]
        if h4 % 100 < spm_rate:
            return doc_id, tree.lines, "spm", chars, upto - chars, b"".join((s, suffix, p, prefix, m, middle))
        return doc_id, tree.lines, "psm", chars, upto - chars, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(rows):
            cols = list(zip(*rows))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], _OUT.names)

        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            rows, held = [], 0
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                rows.append(one(doc_id, data[offsets[i]:offsets[i + 1]]))
                held += len(rows[-1][-1])
                if held > BATCH_BYTES:
                    yield send(rows)
                    rows, held = [], 0
            if rows:
                yield send(rows)
    return run


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` (doc_id, text, any further columns, which are left out) ->
    doc_id, n (lines), form, prefix_chars, middle_chars, output; one row per
    input row. ``rate`` per cent of the texts are transformed, of these
    ``spm_rate`` per cent suffix first, by keyed draws of doc_id: repeated rows
    come out alike, and all null ids draw the same.

    Null texts count as empty. Empty texts and texts that hold a sentinel stay
    plain (null char counts). A text of any length is cut whole; a task holds
    one Arrow batch of texts. Empty input gives no rows."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text").cast("string")).alias("text")).mapInArrow(_transform(rate, spm_rate, seed, sentinels), _OUT)


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    # No sentinel occurs in a transformed text, so these are its three parts.
    part = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
