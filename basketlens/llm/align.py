"""Alignment of two tokenizers' tokens over whole texts.

Both tokenizers spell space + text, so their tokens are byte ranges of one
string. In each block of documents pandas' merge_asof, keyed by document, finds
for every token start the other side's token that covers it; the union of both
directions is the set of overlapping pairs (links), and offsets where tokens of
both sides end cut the text into groups.

Corpus-wide counts: a block keeps each of its id pairs once, with the number of
its documents that hold it, and its documents refer to them by place. So only
distinct pairs of blocks are counted and given their counts back, not links.

A block is stored as many small rows (see ``_rows``): Parquet is written and read
some hundred or thousand rows at a time, so rows as large as a block would take
memory by the number of blocks a task meets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INT, LONG, STRING, Scratch, prepare, read_table, schema

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Pre-tokenization of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
BLOCK_CHARS = 1 << 20
#: Entries of a list in one row of the table of blocks.
PART = 1024
#: That table is written and read in row groups of this size.
STORED = {"parquet.block.size": str(16 << 20)}


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for code points from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ``encode(texts)`` and the bytes of each id."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(b) for b in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = len(spelled)
        # Ids as text with what follows them in the written form of groups.
        self.inner = np.array([f"{i}," for i in range(self.width)], object)
        self.last = np.array([f"{i}{self.closing}" for i in range(self.width)], object)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - size), size)]


class ByteLevel(Side):
    closing = "|"

    def __init__(self, path: str = BYTE_BPE):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, special = model["model"]["vocab"], {t["content"] for t in model["added_tokens"] if t["special"]}
        of = _byte_of_symbol()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids do not follow the order of the merges")
        spelled = [b""] * (max(vocab.values()) + 1)
        for b, i in ranks.items():
            spelled[i] = b
        super().__init__(spelled)
        self.coder = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) if t else [] for t in texts]


class Piece(Side):
    closing = ";"

    def __init__(self, path: str = PIECES):
        import sentencepiece
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        super().__init__([bytes([int(n[1:-1], 16)]) if self.coder.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Tokens:
    """Tokens of one side of a block: ids, document of each, byte range."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, size: np.ndarray):
        self.ids, self.doc = ids, doc
        self.end = np.cumsum(size[ids])
        self.start = self.end - size[ids]


class Block:
    """Aligned tokens of some texts (null counts as empty)."""

    def __init__(self, a: Side, b: Side, texts: list[str | None]):
        raw = [(" " + t).encode() if t else b"" for t in texts]
        self.n = n = len(texts)
        flat, doc = [], []
        for side in (a, b):
            ids = side.encode([t or "" for t in texts])
            flat.append(np.fromiter((i for x in ids for i in x), np.int64))
            doc.append(np.repeat(np.arange(n), [len(x) for x in ids]))
        wanted = np.array([len(r) for r in raw], np.int64)
        fits = wanted > 0
        for side, ids, d in zip((a, b), flat, doc):
            fits &= np.bincount(d, weights=side.size[ids], minlength=n).astype(np.int64) == wanted
        # Equal lengths line the bytes up; texts that either side spells otherwise have no tokens.
        text = np.frombuffer(b"".join(r for r, f in zip(raw, fits) if f), np.uint8)
        owner = np.repeat(np.flatnonzero(fits), wanted[fits])
        for side, ids, d in zip((a, b), flat, doc):
            fits[owner[side.spell(ids[fits[d]]) != text]] = False
            if not fits[owner].all():
                keep = fits[owner]
                text, owner = text[keep], owner[keep]
        self.a, self.b = (Tokens(ids[fits[d]], d[fits[d]], side.size) for side, ids, d in zip((a, b), flat, doc))
        self.sides = a, b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens whose byte ranges overlap."""
        left = pd.DataFrame({"start": self.a.start, "doc": self.a.doc, "a": np.arange(len(self.a.ids))})
        right = pd.DataFrame({"start": self.b.start, "doc": self.b.doc, "b": np.arange(len(self.b.ids))})
        over = pd.merge_asof(left, right, on="start", by="doc")
        back = pd.merge_asof(right, left, on="start", by="doc")
        if not len(left):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        later = self.a.start[back["a"].to_numpy()] != self.b.start  # equal starts were found from the other side
        return np.concatenate([over["a"].to_numpy(), back["a"].to_numpy()[later]]), np.concatenate([over["b"].to_numpy(), back["b"].to_numpy()[later]])

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group of each A token, whether it ends it; the same for B)."""
        out = []
        for one, other in ((self.a, self.b), (self.b, self.a)):
            at = np.searchsorted(other.end, one.end)
            ends = other.end[np.minimum(at, len(other.end) - 1)] == one.end if len(other.end) else np.zeros(0, bool)
            out += [np.cumsum(ends) - ends, ends]
        return tuple(out)

    def written(self, group_a, end_a, group_b, end_b) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        a, b = self.sides
        items = np.empty(len(group_a) + len(group_b), object)
        items[np.arange(len(group_a)) + np.searchsorted(group_b, group_a)] = np.where(end_a, a.last[self.a.ids], a.inner[self.a.ids])
        items[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = np.where(end_b, b.last[self.b.ids], b.inner[self.b.ids])
        cut = np.concatenate([[0], np.cumsum(self.count(self.a.doc) + self.count(self.b.doc))])
        return ["".join(items[cut[i]:cut[i + 1]])[:-1] for i in range(self.n)]

    def count(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n).astype(np.int64)


def _blocks(chars: int):
    """(doc_ids, texts) of about ``chars`` code points, across Arrow batches."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= chars:
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts
    return cut


_LONGS, _INTS = T.ArrayType(LONG), T.ArrayType(INT)
_BLOCK = schema(block=LONG, kind=STRING, at=LONG, doc_id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, groups_sha256=STRING, held=LONG, place=_INTS, times=_INTS, pair=_LONGS, docs=_INTS)
_ARROW = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32())]


def _rows(kind: str, block: int, at: np.ndarray, **cols) -> pa.RecordBatch:
    """Rows of a block, their places in it ``at``: a document each (``doc``, with
    how many pairs it has), or PART entries of the documents' pairs one after the
    other (``held``) or of the block's pairs (``pair``)."""
    given = {"block": np.full(len(at), block), "kind": [kind] * len(at), "at": at} | cols
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(len(at), t) for c, t in zip(_BLOCK.names, _ARROW)], _BLOCK.names)


def _lists(kind: str, block: int, **cols: np.ndarray) -> pa.RecordBatch:
    """Columns of equal length as rows of PART entries."""
    at = np.arange(0, len(next(iter(cols.values()))), PART)
    return _rows(kind, block, at, **{c: [x[i:i + PART] for i in at] for c, x in cols.items()})


def _aligned(paths: tuple[str, str], chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteLevel(paths[0]), Piece(paths[1])
        first = TaskContext.get().partitionId() << 33
        for number, (ids, texts) in enumerate(_blocks(chars)(batches), first):
            block = Block(a, b, texts)
            in_a, in_b = block.links()
            doc = block.a.doc[in_a]
            # Ids of a pair in one number; a document's pairs once, with how often they are linked.
            every, pair = np.unique(block.a.ids[in_a] * b.width + block.b.ids[in_b], return_inverse=True)
            held, times = np.unique(doc * max(1, len(every)) + pair, return_counts=True)
            owner, place = np.divmod(held, max(1, len(every)))
            groups = block.groups()
            said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in block.written(*groups)]
            yield _rows("doc", number, np.arange(block.n), doc_id=ids, n_a=block.count(block.a.doc), n_b=block.count(block.b.doc), n_groups=block.count(block.a.doc[groups[1]]), n_links=block.count(doc), groups_sha256=said, held=block.count(owner))
            yield _lists("held", number, place=place, times=times)
            yield _lists("pair", number, pair=every, docs=np.bincount(place, minlength=len(every)))
    return run


_OUT = schema(doc_id=LONG, n_a=LONG, n_b=LONG, n_groups=LONG, n_links=LONG, n_best=LONG, count_sum=LONG, groups_sha256=STRING)


def _weighed(rows: pa.Table, weights: pa.Table) -> pa.Table:
    """One block's documents with the counts of its pairs."""
    rows, found = rows.sort_by("at"), weights.sort_by("pos")
    docs, parts = (rows.filter(pc.equal(rows["kind"], kind)) for kind in ("doc", "held"))
    place, times = (pc.list_flatten(parts[c]).to_numpy().astype(np.int64) for c in ("place", "times"))
    cut = np.concatenate([[0], np.cumsum(docs["held"].to_numpy())])

    def per_doc(value):
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(times * value[place])])[cut]))
    cols = {c: docs[c] for c in _OUT.names if c in docs.column_names} | {"n_best": per_doc(found["best"].to_numpy()), "count_sum": per_doc(found["n"].to_numpy())}
    return pa.table([cols[c] for c in _OUT.names], names=_OUT.names)


def alignment(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, any further columns, which are left out) -> the
    columns of _OUT, one row per input row. The count of an id pair is the
    number of rows that hold it linked; n_best counts links whose pair has its A
    id's highest count, ties included, and count_sum adds the counts of all links.

    Null and empty texts, and texts that one side does not spell byte for byte
    (they hold U+2581), have no tokens: zeros and ''. Repeated rows count each;
    null ids stay null. Whole texts are tokenized; a task's memory follows the
    longest text or ``block_chars``, whichever is more. Empty input gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.table("blocks", texts.mapInArrow(_aligned((byte_bpe, pieces), block_chars), _BLOCK), options=STORED)
    pairs = blocks.where(F.col("kind") == "pair")
    counts = scratch.table("counts", pairs.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.docs").alias("n")))
    width = Piece(pieces).width
    first = F.floor(F.col("pair") / width)
    best = counts.groupBy(first.alias("id")).agg(F.max("n").alias("most"))
    weighed = counts.withColumn("id", first).join(best, "id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    found = (pairs.select(F.col("block").alias("of"), "at", F.posexplode("pair").alias("step", "pair"))
                  .select("of", (F.col("at") + F.col("step")).alias("pos"), "pair").join(weighed, "pair").select("of", "pos", "n", "best"))
    docs_of = blocks.where(F.col("kind") != "pair").drop("pair", "docs")
    return docs_of.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_weighed, _OUT)


class TokenLinks:
    """Aligned tokens themselves: doc_id, a, b (ids), group_a, group_b (from 0),
    links (a_place, b_place within the document)."""

    COLUMNS = T.StructType([*schema(doc_id=LONG, a=_INTS, b=_INTS, group_a=_INTS, group_b=_INTS), T.StructField("links", T.ArrayType(schema(a=INT, b=INT)))])

    def __init__(self, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block_chars: int = BLOCK_CHARS):
        self.paths, self.chars = (byte_bpe, pieces), block_chars

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteLevel(self.paths[0]), Piece(self.paths[1])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for ids, texts in _blocks(self.chars)(batches):
            block = Block(a, b, texts)
            group_a, end_a, group_b, _ = block.groups()
            at = [np.concatenate([[0], np.cumsum(block.count(d))]) for d in (block.a.doc, block.b.doc, block.a.doc[end_a])]
            in_a, in_b = block.links()
            order = np.lexsort((in_b, in_a))
            in_a, in_b = in_a[order], in_b[order]
            doc = block.a.doc[in_a]
            cut = np.concatenate([[0], np.cumsum(block.count(doc))])
            rows = [(x, block.a.ids[at[0][i]:at[0][i + 1]], block.b.ids[at[1][i]:at[1][i + 1]], group_a[at[0][i]:at[0][i + 1]] - at[2][i], group_b[at[1][i]:at[1][i + 1]] - at[2][i],
                     [{"a": p, "b": q} for p, q in zip((in_a[cut[i]:cut[i + 1]] - at[0][i]).tolist(), (in_b[cut[i]:cut[i + 1]] - at[1][i]).tolist())]) for i, x in enumerate(ids)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(list(c), pa.list_(pa.int32())) for c in cols[1:5]), pa.array(list(cols[5]), kind)], self.COLUMNS.names)


def token_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` -> the columns of TokenLinks, one row per input row; empty lists
    for texts without tokens (see ``alignment``)."""
    prepare(docs.sparkSession)
    run = TokenLinks(byte_bpe, pieces, block_chars)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: run(batches), TokenLinks.COLUMNS)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))
