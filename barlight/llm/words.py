"""Vectorised word and shingle hashing of Arrow text batches.

Separators are ASCII in every word definition used by this subpackage, so
words can be cut on UTF-8 bytes and hashed without decoding. All functions
take whole texts; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SEED = np.random.default_rng(20240229)
#: One random 64-bit value for each byte, and the base of the polynomial with its inverse.
_VALUE = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; bounds the working memory of hash_words.
_BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separator_table(spans: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over bytes, true for the inclusive ranges given."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


WHITE = separator_table([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and would keep the largest peak it had."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: Bytes of text that a worker takes up at once.
SLICE_BYTES = 1 << 22


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text, one row at least."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)) + 64
    cut = (np.cumsum(size) - size) // most
    edges = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1], [True]])) if len(cut) else np.zeros(1, int)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(low, high - low)
        give_back()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (int(n) + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(_BASE, size), _powers(_UNBASE, size)
    return _POWERS[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word in order, and the n + 1 offsets of the rows' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[edges] = inside[edges]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each word; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        high = ends[to - 1]
        power, unpower = _power_tables(high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data[low:high]] * power[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * unpower[s] + (e - s).astype(np.uint64))
        at = to
    return out


def hashed_words(column: pa.Array, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of ASCII-lower-cased texts, and the n + 1 offsets of the rows' words."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, separators)
    return hash_words(data, starts, ends), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their n + 1 offsets.

    A row of fewer words than width, but not none, has one shingle: all its words.
    """
    n = np.diff(rows)
    grams = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for j in range(width):
        grams = mix(grams + words[j : j + len(grams)])
    short = np.flatnonzero((n > 0) & (n < width))
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    full = np.flatnonzero(n >= width)
    out = np.concatenate([[0], np.cumsum(counts)])
    keys = np.empty(out[-1], dtype=np.uint64)
    if len(full):
        keep = np.zeros(len(words) + 1, dtype=np.int32)
        np.add.at(keep, rows[:-1][full], 1)
        np.add.at(keep, rows[1:][full] - width + 1, -1)
        inside = np.cumsum(keep)[: len(grams)] > 0
        target = np.ones(len(keys), dtype=bool)
        target[out[:-1][short]] = False
        keys[target] = grams[inside]
    for r in short:
        whole = np.full(1, n[r], dtype=np.uint64)
        for at in range(rows[r], rows[r + 1]):
            whole = mix(whole + words[at : at + 1])
        keys[out[r]] = whole[0]
    for r in full:
        keys[out[r] : out[r + 1]].sort()
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    fresh[out[:-1][counts > 0]] = True
    upto = np.concatenate([[0], np.cumsum(fresh)])
    return keys[fresh], upto[out]
