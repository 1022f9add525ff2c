"""Whole-text word shingles as 64-bit hashes, vectorised over Arrow batches.

Words are maximal runs of code points outside ``\\x20\\x09-\\x0D`` after A-Z is
lower-cased (both rules touch ASCII bytes only, so they hold on UTF-8 bytes).
A document's shingles are its runs of five words; with one to four words the
whole sequence is the single shingle; without words there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POSITION = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                      0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        tables = []
        for base in (_BASE, _BASE_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        if n > 2 * CHUNK_BYTES:  # a giant text: don't keep its tables
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (a longer text stands alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each hash, words per row) for one chunk of rows;
    hashes keep text order and may repeat within a row."""
    rows = len(offsets) - 1
    base = int(offsets[0])
    b = data[base:int(offsets[-1])]
    at = offsets - base
    n = len(b)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    if n == 0:
        return none
    upper = (b >= 65) & (b <= 90)
    b = b + (upper.view(np.uint8) << 5)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    edge = solid.copy()
    edge[1:] &= ~solid[:-1] | first[1:n]
    start = np.flatnonzero(edge)
    if len(start) == 0:
        return none
    edge = solid.copy()
    edge[:-1] &= ~solid[1:] | first[1:n]
    end = np.flatnonzero(edge) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(row, minlength=rows)
    out, out_row = [], []
    k = len(word)
    if k >= WORDS:
        whole = row[WORDS - 1:] == row[:k - WORDS + 1]
        h = word[:k - WORDS + 1] * _POSITION[0]
        for i in range(1, WORDS):
            h = h + word[i:k - WORDS + 1 + i] * _POSITION[i]
        out.append(mix(h[whole]))
        out_row.append(row[:k - WORDS + 1][whole])
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        place = np.concatenate([[0], np.cumsum(count)])
        h = np.zeros(len(short), dtype=np.uint64)
        for i in range(WORDS - 1):
            has = count[short] > i
            h[has] += word[place[short[has]] + i] * _POSITION[i]
        out.append(mix(h + count[short].astype(np.uint64)))
        out_row.append(short)
    if not out:
        return none[0], none[1], count
    hashes, which = np.concatenate(out), np.concatenate(out_row)
    if len(out) == 2:
        order = np.argsort(which, kind="stable")
        hashes, which = hashes[order], which[order]
    return hashes, which, count


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending."""
    data, offsets = text_column(column)
    for a, b in chunks(offsets):
        hashes, which, _ = shingles(data, offsets[a:b + 1])
        cut = np.searchsorted(which, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(hashes[cut[i]:cut[i + 1]])
