"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Pieces and scores come from a SentencePiece model file; a text's encoding is
the segmentation with the largest sum of piece scores (ties: the longest last
piece), with byte fallback for characters that no piece covers. A piece never
spans the start of a run of spaces or a line break, so those cuts are exact and
words are searched one by one: distinct words of equal length advance together,
hashes of their substrings probe the sorted hashes of the pieces, and maxima
over all starts leave the backpointers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INT, LONG, prepare, read_table
from .shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 600_000
CHUNK_CHARS = 1 << 19
CELLS = 1 << 18  # probes of one numpy step, at least one word
DIRECTORY_BITS = 20
NONE = -(1 << 30)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    t = np.full(max(n, 1), base, np.uint64)
    t[0] = 1
    return np.cumprod(t, dtype=np.uint64)


def _prefix_hashes(code: np.ndarray) -> np.ndarray:
    """(rows, length + 1) polynomial prefix hashes of rows of code points."""
    out = np.zeros((code.shape[0], code.shape[1] + 1), np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, code.shape[1]), axis=1, out=out[:, 1:])
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class Pieces:
    """A SentencePiece model's table, as plain arrays (a few MB)."""

    def __init__(self, model: str = MODEL):
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        size = p.get_piece_size()
        self.text = [p.id_to_piece(i) for i in range(size)]
        self.byte_id = np.full(256, p.unk_id(), np.int32)
        self.bytes = [b""] * size
        normal = []
        for i, t in enumerate(self.text):
            if p.is_byte(i):
                self.byte_id[int(t[1:-1], 16)] = i
                self.bytes[i] = bytes([int(t[1:-1], 16)])
            elif not (p.is_control(i) or p.is_unknown(i)):
                normal.append(i)
                self.bytes[i] = t.replace(SPACE, " ").encode("utf-8")
        if any(SPACE in self.text[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece spans a word boundary; words can't be searched one by one")
        lines = "" if any("\n" in self.text[i] for i in normal) else "\n"
        self.word = re.compile(f"{lines}+|{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.longest = max(len(self.text[i]) for i in normal)
        key, value, score = [], [], []
        by_length: dict[int, list[int]] = {}
        for i in normal:
            by_length.setdefault(len(self.text[i]), []).append(i)
        for length, ids in by_length.items():
            h = _prefix_hashes(_codes([self.text[i] for i in ids]))[:, -1]
            key.append(mix(h + np.uint64(length)))
            value += ids
            score += [p.get_score(i) for i in ids]
        key = np.concatenate(key)
        order = np.argsort(key)
        self.key, self.id = np.append(key[order], np.uint64(0)), np.append(np.array(value, np.int32)[order], np.int32(-1))
        self.score = np.append(np.array(score, np.float64)[order], -np.inf)
        self.unknown = float(self.score[:-1].min()) - UNKNOWN_PENALTY
        # First sorted key of each range of hashes; most ranges hold one at most.
        first = np.searchsorted(self.key[:-1], np.arange(1 << DIRECTORY_BITS, dtype=np.uint64) << np.uint64(64 - DIRECTORY_BITS))
        self.first = first.astype(np.int32)
        held = np.diff(np.append(first, len(key)))
        self.crowd, self.crowded = int(held.max()), held > 1

    def find(self, probe: np.ndarray) -> np.ndarray:
        """Place of each probed hash among the sorted keys, or the end."""
        end = np.int32(len(self.key) - 1)
        span = (probe >> np.uint64(64 - DIRECTORY_BITS)).astype(np.int32)
        at = self.first[span]
        hit = self.key[at] == probe
        out = np.where(hit, at, end)
        more = np.nonzero(self.crowded[span] & ~hit)
        if len(more[0]):
            probe, at, best = probe[more], at[more], out[more]
            for step in range(1, self.crowd):
                here = np.minimum(at + np.int32(step), end)
                best = np.where(self.key[here] == probe, here, best)
            out[more] = best
        return out

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words of one length; -1 - code point stands
        for a character without a piece."""
        code = _codes(words)
        n, length = code.shape
        prefix, down = _prefix_hashes(code).T.copy(), _powers(_BASE_INV, length)
        best = np.zeros((length + 1, n))
        back = np.zeros((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            start = np.arange(max(0, end - self.longest), end)
            h = (prefix[end] - prefix[start]) * down[start, None] + (end - start).astype(np.uint64)[:, None]
            at = self.find(mix(h))
            value = self.score[at]
            lone = value[-1] == -np.inf
            value[-1][lone] = self.unknown
            value += best[start]
            to = np.argmax(value, axis=0)
            best[end] = value[to, rows]
            back[end] = start[to]
            chosen = at[to, rows]
            piece[end] = np.where(chosen < len(self.key) - 1, self.id[chosen], -1 - code[:, end - 1].astype(np.int32))
        steps, at = [], np.full(n, length, np.int32)
        while at.any():
            steps.append(np.where(at > 0, piece[at, rows], NONE))
            at = np.where(at > 0, back[at, rows], 0)
        steps = np.stack(steps, axis=1)[:, ::-1]
        real = steps != NONE
        return steps[real], real.sum(axis=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and number of ids of each word)."""
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flats, held = [], 0
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for length, members in groups.items():
            width = max(1, CELLS // (length * min(length, self.longest)))
            for a in range(0, len(members), width):
                part = members[a:a + width]
                ids, count = self._viterbi([words[i] for i in part])
                bare = ids < 0
                if bare.any():  # bytes of characters without a piece
                    spelled = [self.byte_id[list(chr(-1 - i).encode("utf-8", "surrogatepass"))] if i < 0 else [i] for i in ids.tolist()]
                    owner = np.repeat(np.arange(len(part)), count)
                    count = np.bincount(owner, weights=list(map(len, spelled)), minlength=len(part)).astype(np.int64)
                    ids = np.concatenate(spelled).astype(np.int32)
                size[part] = count
                start[part] = held + np.cumsum(count) - count
                flats.append(ids)
                held += len(ids)
        return (np.concatenate(flats) if flats else np.zeros(0, np.int32)), start, size

    def split(self, text: str) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes of the pieces, without the leading space that
        encoding adds."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Encoder:
    """Encodes texts chunk by chunk; remembers up to CACHED_WORDS words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        words = [self.pieces.split(t) for t in texts]
        every = [w for ws in words for w in ws]
        if len(self.known) > CACHED_WORDS:
            self._clear()
        new = list(set(every) - self.known.keys())
        if new:
            flat, start, size = self.pieces.encode_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.start = np.concatenate([self.start, start + len(self.flat)])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = self.size[at]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        place = np.arange(total) + np.repeat(self.start[at] - (end - size), size)
        per = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        return self.flat[place], np.concatenate([[0], end])[per]


def _encode(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        encoder = Encoder(table)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            a = held = 0
            for i, t in enumerate([*texts, None]):
                if t is None or (held and held + len(t) > CHUNK_CHARS):
                    if i > a:
                        flat, offsets = encoder(texts[a:i])
                        same = [table.decode(flat[offsets[k]:offsets[k + 1]]) == texts[a + k] for k in range(i - a)]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").slice(a, i - a), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(same, pa.bool_())],
                            ["doc_id", "n_tokens", "ids", "round_trip"])
                    a, held = i, 0
                held += len(t or "")
    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` (doc_id, text, any further columns) -> doc_id, n_tokens, ids,
    round_trip (decoding the ids gives the text again), one row per input row.

    Null and empty texts have no ids. A text that holds U+2581 decodes to
    spaces there (round_trip false), as in SentencePiece. Repeated rows are
    each encoded; null doc_ids stay null. Empty input gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = spark.sparkContext.broadcast(Pieces(model))
    out = T.StructType([T.StructField("doc_id", LONG), T.StructField("n_tokens", LONG), T.StructField("ids", T.ArrayType(INT)), T.StructField("round_trip", T.BooleanType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(pieces), out)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
