"""Vectorised words and hashes over Arrow batches of UTF-8 text.

A batch's texts are handled as one byte buffer: lower-casing and separators are byte tables, word
hashes come from a prefix sum of a polynomial, so the cost per byte does not depend on how many
words or documents there are.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a single longer text is taken whole.
CHUNK_BYTES = 2 << 20
#: Bytes of rows in a batch that Spark hands to Python.
BATCH_BYTES = 4 << 20
#: Bytes that are expanded into 64-bit arrays at once, or one longer word.
HASH_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 5  # odd, so invertible
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 for bytes that separate words.  Bytes above 0x7F always belong to a word.
WHITE_SPACE = bytes(int(b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))
NOT_ALPHANUMERIC = bytes(int(b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256))


@functools.cache
def _c_library():
    with contextlib.suppress(OSError):
        return ctypes.CDLL("libc.so.6")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session now hands Python batches of at most ``BATCH_BYTES``, unless it has a lower limit.

    Spark's own limit is 64 MB, which each worker and the JVM beside it hold several times.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:])
    if not 0 < (int(now[:-1]) * unit if unit else int(now)) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def trim() -> None:
    """Return freed memory to the system.  Workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):
        _c_library().malloc_trim(0)


def _made_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_P, _P_INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    return made[0], made[1]


_kept_powers = functools.cache(_made_powers)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; only those for ordinary blocks are kept."""
    return _kept_powers(2 * HASH_BYTES) if n <= 2 * HASH_BYTES else _made_powers(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and n + 1 offsets.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str | tuple[str, str] = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one text.

    ``column`` is the text's name, or (struct, field).
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(text_in(batch, column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            last = min(last, batch.num_rows, first + 60_000)
            yield batch.slice(first, last - first)
            first = last
    trim()


def text_in(batch: pa.RecordBatch, column: str | tuple[str, str]) -> pa.Array:
    """A text column, or a text field of a struct column, which then need not travel twice."""
    return batch.column(column) if isinstance(column, str) else pc.struct_field(batch.column(column[0]), column[1])


class Words:
    """Words of a batch: ``start`` and ``end`` in ``data``, ``counts`` by document, ``doc`` of each word."""

    def __init__(self, column: pa.Array, separators: bytes = WHITE_SPACE, lower: bool = True):
        raw, self.offsets = utf8(column)
        blob = raw.tobytes()
        if lower:
            blob = blob.translate(LOWER_ASCII)
        self.blob = blob
        self.data = np.frombuffer(blob, np.uint8)
        n = len(self.data)
        self.n_docs = len(self.offsets) - 1
        word = np.frombuffer(blob.translate(separators), np.uint8) == 0
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~word[:-1]
        after[:-1] = ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        at = np.searchsorted(self.start, self.offsets)
        self.first = at[:-1]
        self.counts = np.diff(at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every batch."""
        return span_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> str:
        return self.blob[self.start[i] : self.end[i]].decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are sorted and do not overlap.

    Spans are taken by blocks of ``HASH_BYTES``, so the memory in use does not depend on the text.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + HASH_BYTES)))
        low, high = int(start[i]), int(end[j - 1])
        power, inverse = _power_tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], dtype=np.uint64, out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; the i-th starts at value i.  Runs may cross documents."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out = out * factor + words[k : k + len(out)]
    return mix(out + np.uint64(size))


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct word of a batch, and for each word the number of its distinct word."""
    _, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return at, inverse


def packed(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words at positions ``at``, a zero byte before each and one after the last, and each one's offset."""
    sizes = words.end[at] - words.start[at]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.zeros(int(offsets[-1]) + 1, np.uint8)
    source = np.repeat(words.start[at] - offsets[:-1] - 1, sizes) + (to := _ranges(offsets[:-1] + 1, sizes))
    out[to] = words.data[source]
    return out, offsets[:-1]


def _ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of sizes[0] values, then those of the next range."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)


def has_letter(words: Words) -> np.ndarray:
    """For each document of a batch whether its text holds a letter of any script."""
    data = words.data
    total = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    out = total[words.offsets[1:]] > total[words.offsets[:-1]]
    for d in np.flatnonzero(~out & (words.counts > 0)):
        raw = words.blob[words.offsets[d] : words.offsets[d + 1]]
        out[d] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return out
