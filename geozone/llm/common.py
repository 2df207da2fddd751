"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from inspect import signature
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that a Python worker handles at a time. A single longer text is handled alone.
SLICE_BYTES = 8 << 20
# Only some C libraries have it; elsewhere freed memory stays with the worker.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns what the process has freed to the system. Workers outlive their tasks, so the most that one stage needed would
    otherwise stay with them beside what the next stages need."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_kept: dict[Hashable, Any] = {}


def kept(owner: Hashable, make: Callable[[], Any]) -> Any:
    """What an earlier task of the same query, its `owner`, made on this Python worker, or else made now."""
    forget(owner)
    if owner not in _kept:
        _kept[owner] = make()
    return _kept[owner]


def forget(owner: Hashable = None) -> None:
    """Drops what other queries than `owner` keep on this worker: workers serve one query after the other."""
    if _kept.keys() - {owner}:
        for name in _kept.keys() - {owner}:
            del _kept[name]
        give_back()


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, owner: Hashable = None
) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has about `limit` bytes of `column`: memory does not follow the row count.

    What queries other than `owner` keep on the worker goes first.
    """
    forget(owner)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)
        give_back()


def gathered(batches: Iterable[pa.RecordBatch], rows: int, limit: int = 64 << 20) -> Iterator[pa.Table]:
    """Small batches put together to tables of about `rows` rows or `limit` bytes."""
    forget()
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= limit:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    held = []
    give_back()


def tidied(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """`run` for groups (key, rows) or pairs of them (key, rows, rows): what the worker kept of other queries goes before, what
    `run` has freed goes back after."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        forget()
        out = run(key, rows)
        give_back()
        return out

    def two(key: tuple, rows: pa.Table, others: pa.Table) -> pa.Table:
        forget()
        out = run(key, rows, others)
        give_back()
        return out

    return two if len(signature(run).parameters) == 3 else one


def fixed_words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column whose values all have the same multiple of eight bytes, as rows of little-endian words."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint64)


def row_key() -> tuple:
    """Columns that tell rows apart by id and text; rows with the same id and text are the same document."""
    return F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")
