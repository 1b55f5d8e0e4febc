"""Shared pieces for the text operators: Arrow columns as NumPy bytes, word spans, rolling hashes, bounded samples.

Everything here is vectorised over a chunk of documents whose UTF-8 bytes lie end to end, so the cost is a
few nanoseconds a byte and memory stays proportional to the chunk, however long the table is.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; a single longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is true inside the given inclusive byte ranges."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python objects made of them stay few."""
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(first, rows)


def give_back() -> None:
    """Returns to the system what this process has freed: Python workers are used again, and hold the room of an earlier stage's arrays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def chunked(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (first, last) of about ``limit`` bytes each."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def find_words(data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray):
    """Start and end of each maximal run of word bytes inside a row, and each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    inside = word_bytes[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    opens[inner] |= inside[inner]
    closes[inner - 1] |= inside[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums from which ``span_hash`` takes the hash of any span."""
    up, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chain(*parts: np.ndarray, seed: int = 1) -> np.ndarray:
    """One hash for each row of equally long arrays, sensitive to their order."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out


def fold_rule(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves the remainder; a null id is false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of the key: the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that a table with the columns ``taken`` doesn't have, whatever their case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
