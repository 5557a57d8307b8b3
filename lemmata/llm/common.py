"""Helpers shared by the training-data operators: hashes, text buffers, and tables in the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.scratch import forget, keep, scratch_dir  # noqa: F401  used by the operators

#: A word is a maximal run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Batches between Spark and Python of at most ``most`` bytes in what is executed inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one that is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and n + 1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Cut a batch into slices whose ``column`` holds about ``most`` bytes each (one row at least)."""
    _, offsets = text_buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: multiplications and xor-shifts over uint64, modulo 2**64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))


#: Strings of more bytes are hashed by a digest: polynomials modulo 2**64 are equal for some long strings, in every odd base.
LONG = 256


def _digest_long(hashed: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """``hashed`` with 64 bits of a keyed digest in place of the hash of each long string."""
    for k in np.flatnonzero(end - start > LONG).tolist():
        hashed[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=int(base).to_bytes(8, "little")).digest(), "little")
    return hashed


def substring_hashes(data: np.ndarray, offsets: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of each of the strings that lie one after another in ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, max(0, len(data) - 1))[: len(data)], out=sums[1:])
    back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data))
    hashed = mix64((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]] + np.diff(offsets).astype(np.uint64))
    return _digest_long(hashed, data, offsets[:-1], offsets[1:], base)


def runs(data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``own`` bytes within a text, and a 64-bit hash of the run's bytes."""
    begin, stop = own.copy(), own.copy()
    begin[1:] &= ~own[:-1]
    stop[:-1] &= ~own[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]  # a run ends with its text
    begin[edges] = own[edges]
    if len(edges) > 1:
        stop[edges[1:] - 1] = own[edges[1:] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    # a polynomial of the bytes, each run's from one running sum
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data) - 1), out=sums[1:])
    hashed = mix64((sums[end] - sums[start]) * powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    return start, end, _digest_long(hashed, data, start, end, _BASE)
