"""Arrow batches cut into slices of bounded text, so that a task's memory does not follow its partition."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds at once, besides one text of any length.
SLICE_BYTES = 1 << 20

#: Spark's bound on the bytes of an Arrow batch and that setting's default.
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def named(name: str) -> Column:
    """The column of just that name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound(spark: SparkSession, most: str = "3m") -> None:
    """Batches of at most ``most`` (or one row) between Spark and Python, unless the session has a bound of its own."""
    if spark.conf.get(_KEY, _DEFAULT) == _DEFAULT:
        spark.conf.set(_KEY, most)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its memory goes back to the system, as Spark keeps Python workers for later tasks."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return kept


def give_back() -> None:
    """Returns freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of about the same size, with up to ``most`` bytes in the column, or with one row."""
    texts = batch.column(column)
    if not len(texts):
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    total = sum(sizes)
    even = min(most, total // -(-total // most) + most // 16) if total else most
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > even:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)
