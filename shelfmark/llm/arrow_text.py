"""Vectorised handling of text columns inside Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import pickle
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def cached(key: str, build: Callable):
    """One object per Python worker: tasks of a reused worker share it."""
    store = sys.modules.setdefault("_shelfmark_worker_cache", types.ModuleType("_shelfmark_worker_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def tidy(run: Callable) -> Callable:
    """run over Arrow batches; at its end the worker gives freed memory back, since it may idle while others need it."""

    @functools.wraps(run)  # Spark reads the types of a group's function
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow over all columns, whatever their names: run gets them as c0, c1 and so on."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(tidy(run), schema)


def pack(obj, level: int = 1) -> bytes:
    """A pickled object under zstd, with its plain size in front."""
    raw = pickle.dumps(obj, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(data: bytes):
    size = int.from_bytes(data[:8], "little")
    return pickle.loads(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True))


def planes(values: np.ndarray) -> bytes:
    """A uint32 array as its four byte planes, which compress far better than its words."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Numbers under this have one byte in coded; those under TWO have two, others four.
ONE, TWO = 192, 192 + 63 * 256


def coded(values: np.ndarray) -> bytes:
    """A uint32 array as its number of values, then first bytes, second bytes of those with two, and all of those with four."""
    v = values.astype(np.uint32)
    two, four = (v >= ONE) & (v < TWO), v >= TWO
    first = np.where(two, ONE + ((v - ONE) >> 8), np.where(four, 255, v)).astype(np.uint8)
    return b"".join([len(v).to_bytes(8, "little"), first.tobytes(), ((v[two] - ONE) & 255).astype(np.uint8).tobytes(), planes(v[four])])


def uncoded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    first = np.frombuffer(data, np.uint8, n, 8)
    out = first.astype(np.uint32)
    two, four = (first >= ONE) & (first < 255), first == 255
    n_two = int(two.sum())
    second = np.frombuffer(data, np.uint8, n_two, 8 + n)
    out[two] = ((out[two] - ONE) << 8) + second + ONE
    out[four] = unplanes(data[8 + n + n_two :])
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, each from its first to before its last, of at most that many of what the offsets count (a longer row alone)."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, last
        first = last


def pieces(batches, text: str | int, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most most_bytes of text (a longer text alone): rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_buffers(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
        for first, last in runs(at, most_bytes):
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def spans_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in mask; runs do not cross the offsets in at."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(mask))]
    first[edges] = mask[edges]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[edges - 1] = mask[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as Arrow values; touching spans share the buffer, others are copied together."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and int(lengths.sum()) == len(data) and starts[0] == 0:
        body = data
    else:
        keep = np.zeros(len(data) + 1, np.int8)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends, -1)
        body = data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def digest64(values: list[bytes]) -> np.ndarray:
    """xxh3 of each value."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
