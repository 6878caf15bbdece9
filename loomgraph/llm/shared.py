"""Helpers that the operators of this subpackage share: shared-folder tables, sizing, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import forget, read, shared_dir, written

__all__ = ["blobs", "chunks", "doc_ids", "forget", "give_back", "grouped", "parts", "pieces", "plan_bytes", "prime", "read", "shared_dir", "unused", "utf8_buffers", "written"]

#: Text handed to one vectorised step; bounds the scratch arrays of a Python worker.
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and would hold what the greatest step took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blobs(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The values of a binary column, without copies."""
    return [x.as_buffer() for chunk in column.chunks for x in chunk]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as make it differ from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def prime(n: int) -> int:
    """The least prime from n on."""
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def plan_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of input for choosing numbers of partitions: the optimizer's estimate, or a count where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def pieces(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // each))


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of whole rows of about `size` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def doc_ids(batch: pa.RecordBatch, column: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64, and whether each is present."""
    ids = batch.column(column)
    ok = np.ones(len(ids), bool) if not ids.null_count else np.asarray(ids.is_valid())
    return np.asarray(ids.fill_null(0).cast(pa.int64())), ok


#: Tasks of an exchange at most; with more buckets a task takes several, one after the other.
MOST_TASKS = 1 << 15


@lru_cache(8)
def _slots(tasks: int) -> np.ndarray:
    found = np.full(tasks, -1, np.int64)
    at = 0
    while (found < 0).any():
        x = np.arange(at, at + 4 * tasks + 64, dtype=np.uint32)
        at += len(x)
        # Spark's hash of an int, Murmur3 with seed 42
        k = x * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        to = h.view(np.int32).astype(np.int64) % tasks
        found[to[::-1]] = np.where(found[to[::-1]] < 0, x[::-1], found[to[::-1]])
    return found.astype(np.int32)


def parts(buckets: np.ndarray, n: int, tasks: int = MOST_TASKS) -> np.ndarray:
    """For each of n buckets a number that Spark's hash sends to a task of its own (of `tasks`, or n if that is less), so
    that no task gets many buckets by chance while another has none.  Buckets from n on are those of n less."""
    tasks = min(n, tasks)
    return _slots(tasks)[np.asarray(buckets) % n % tasks]


def grouped(rows: DataFrame, n: int):
    """Rows (part, bucket, ...) by part and bucket, in as many tasks as follow the input (not the session's setting)."""
    return rows.repartition(min(n, MOST_TASKS), "part").groupBy("part", "bucket")
