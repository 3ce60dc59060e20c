"""Texts of an Arrow batch as one run of bytes, and the words in it, without a Python loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at once. A longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Rows with texts that go to Python at once.
ROWS_AT_ONCE = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_batches(rows: DataFrame, step: Step, schema) -> DataFrame:
    """``rows.mapInArrow`` for rows with texts: few rows at a time (this sets the session's Arrow batch to ROWS_AT_ONCE
    if it is larger), and a worker gives memory back when its task ends, as the next one may need another step."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING)) <= ROWS_AT_ONCE:
        conf.set(_ROWS_SETTING, str(ROWS_AT_ONCE))

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass

    return rows.mapInArrow(run, schema)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of text each, every row in exactly one."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(batch.schema.get_field_index(column)))[1][1:]
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the rows one after another, and where each row begins (one more for the end); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: A-Z to a-z, all other bytes unchanged: in UTF-8, no byte of a longer character lies in that range.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a chunk: the row and the byte range of each, and a 64-bit hash of its lower-cased bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ODD = 0x9E3779B97F4A7C15
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int, base: int = _ODD) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> Words:
    """Maximal runs of word bytes of each row, lower-cased. ``in_word``: the byte values that belong to words."""
    low = LOWER[data]
    inside = in_word[low]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    first = inside & ~before[:-1]
    rows = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[rows] = inside[rows]
    start = np.flatnonzero(first)
    none = np.zeros(0, np.int64)
    if not len(start):
        return Words(none, none, none, np.zeros(0, np.uint64))
    kept = np.flatnonzero(inside)
    ordinal = np.searchsorted(kept, start)  # of each word's first byte among the word bytes
    size = np.diff(np.append(ordinal, len(kept)))
    place = np.arange(len(kept)) - np.repeat(ordinal, size)
    value = np.add.reduceat(_BYTE_VALUES[low[kept]] * _powers(int(size.max()))[place], ordinal)
    return Words(np.searchsorted(bounds, start, "right") - 1, start, start + size, mixed(value ^ size.astype(np.uint64)))


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words at which ``n`` words of one row follow one another, and the hash of each such window."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(count, np.uint64)
    for power, k in zip(_powers(n, 0xC2B2AE3D27D4EB4F), range(n), strict=True):
        value += words.hash[k : k + count] * power
    at = np.flatnonzero(words.row[:count] == words.row[n - 1 : n - 1 + count])
    return at, mixed(value[at] ^ np.uint64(n))
