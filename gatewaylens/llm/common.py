"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that a Python worker works on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of `column`, so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(start, stop - start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def return_memory() -> None:
    """What Arrow's pool and the process's heap hold without using it goes back to the system.

    Spark keeps the worker process, idle or for other stages, and an executor pays for all of its workers.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the heap of numpy and Python, where the C library is glibc
        trim(0)


def memory_returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow; a worker returns memory at the end of a partition."""

    def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            return_memory()

    return returning


def group_returned(run: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """`run` on the tables of a group; a worker returns memory after each group."""
    try:
        return run(*tables)
    finally:
        return_memory()
