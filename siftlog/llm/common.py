"""Helpers of the corpus operators: rows in Arrow, words as arrays, keys of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.session import prepare

# A word is a run of bytes other than space and \x09-\x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
# Text bytes that are worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 20
# An array in memory has fewer numbers than two to this power.
MOST_DOUBLINGS = 26
# Rows and bytes that Spark hands to Python at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[9:14] = False
_IS_WORD[32] = False
# Letters and digits of ASCII and all else beyond it; A-Z read as a-z.
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[128:] = True
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    _IS_LETTER[_first:_last] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes of a batch that goes to Python, where the session has Spark's own values."""
    for key, usual, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"),
    ):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, value)
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """The sums of the first, first two, ... numbers of an array, in passes that double their reach: n log n for n numbers."""

    def reach(width: int) -> Callable[[Column], Column]:
        def add(sums: Column) -> Column:
            # As a constant, the array of zeros would be made beforehand, whatever its length.
            zeros = F.array_repeat(F.lit(0), F.least(F.size(sums), F.lit(width)))
            before = F.concat(zeros, F.slice(sums, F.lit(1), F.size(sums) - width))
            return F.when(F.size(sums) > width, F.zip_with(sums, before, lambda a, b: a + b)).otherwise(sums)

        return add

    for place in range(MOST_DOUBLINGS):
        values = bound(values, reach(1 << place))
    return values


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id. Rows equal in id and text count as one document stored twice."""
    return F.xxhash64(text)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running sum."""
    n = len(data)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts])


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in order; works on about CHUNK_BYTES at a time."""
    if len(data) <= 2 * CHUNK_BYTES or not len(starts):
        return _range_hashes(data, starts, ends)
    parts, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        parts.append(_range_hashes(data[a:b], starts[first:last] - a, ends[first:last] - a))
        first = last
    return np.concatenate(parts)


@dataclass(frozen=True)
class Chunk:
    """Some whole rows of a text column.

    `bounds` has the byte where each row begins, and the end; `starts`, `ends` the
    words, `row` their row in the chunk.
    """

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def word_hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    def word_bounds(self) -> np.ndarray:
        """The first word of each row, and the number of words."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged lie in each row."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.bounds])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def chunks(texts: pa.Array, plain: bool = False) -> Iterator[Chunk]:
    """The rows of a text column in order, some at a time, with their words.

    `plain` takes A-Z as a-z and all other ASCII signs as gaps between words.
    """
    data, offsets = text_buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        part, bounds = data[a:b], offsets[first : last + 1] - a
        inside = (_IS_LETTER if plain else _IS_WORD)[part]
        part = _LOWER[part] if plain else part
        edges = bounds[:-1][bounds[:-1] < len(part)]
        before = np.zeros(len(part), dtype=bool)
        before[1:] = inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(part), dtype=bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(bounds, starts, "right") - 1
        yield Chunk(first, part, bounds, starts, ends, row)
        first = last


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of `n` neighbours; there are n - 1 fewer."""
    out = np.zeros(max(len(hashes) - n + 1, 0), dtype=np.uint64)
    for i in range(n if len(out) else 0):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + len(out)]
    return mix(out)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
