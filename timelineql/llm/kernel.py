"""Vectorised text kernel: words, lines and hashes of whole Arrow columns with numpy, never a Python loop over words.

A *word* is a maximal run of letters and digits of the lower-cased text, where every non-ASCII byte counts as a letter. Hashes of
spans come from one running polynomial sum over the bytes of a block, so the hash of any span costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
WORD = np.zeros(256, bool)
WORD[128:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORD[ord(_a) : ord(_b) + 1] = True
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, grown when a longer text comes."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, BLOCK_BYTES + 1)
        for base, name in ((_BASE, "_pow"), (_INVERSE, "_inv")):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a column into (first row, bytes, offsets of its rows and the end), each of at most limit bytes or one row."""
    column = strings(column)
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses an offset."""
    w = WORD[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def running(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """Running polynomial sums: see span_hash."""
    power, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(values[data] * power[:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, from running(); equal content gives equal hashes wherever it stands."""
    _, inverse = powers(len(h))
    return mix((h[ends] - h[starts]) * inverse[starts])


def sequence_sums(h: np.ndarray) -> np.ndarray:
    """Running sums over a sequence of hashes, for span_hash over runs of words in place of bytes."""
    power, _ = powers(len(h) + 1)
    s = np.empty(len(h) + 1, np.uint64)
    s[0] = 0
    np.cumsum(h * power[: len(h)], out=s[1:])
    return s


def stretches(data: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts bytes into stretches of about limit bytes that end between words; a longer word is in one stretch."""
    a = 0
    while a < len(data):
        b = min(len(data), a + limit)
        while b < len(data) and WORD[data[b - 1]] and WORD[data[b]]:
            free = np.flatnonzero(~WORD[data[b : b + limit]])
            b = b + int(free[0]) if len(free) else min(len(data), b + limit)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends of the words, and for each row the index of its first word (and the end). A long row is worked through in stretches,
    so that what is held besides the result doesn't grow with it."""
    if len(data) <= 2 * limit:
        s, e = word_spans(data, offsets)
        return span_hash(running(data), s, e), s, e, np.searchsorted(s, offsets)
    parts = []
    for a, b in stretches(data, limit):
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b)]
        s, e = word_spans(data[a:b], np.concatenate([[a], inner, [b]]) - a)
        parts.append((span_hash(running(data[a:b]), s, e), s + a, e + a))
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, np.searchsorted(s, offsets)


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(span_hash(running(data), np.array([0]), np.array([len(data)]))[0])


def row_of(counts_from: np.ndarray) -> np.ndarray:
    """For offsets of rows, the row of each element."""
    return np.repeat(np.arange(len(counts_from) - 1), np.diff(counts_from))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
