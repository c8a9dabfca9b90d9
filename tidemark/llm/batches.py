"""How many rows a Python task holds at a time, and what its process keeps afterwards."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

# Whole texts per Arrow batch; the session's default suits narrow rows.
TEXT_ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let this session send texts to Python tasks in batches of TEXT_ROWS at most.

    A batch is held several times over in a task (Arrow, Python strings, what is made of them).
    """
    if int(spark.conf.get(_SETTING)) > TEXT_ROWS or int(spark.conf.get(_SETTING)) <= 0:
        spark.conf.set(_SETTING, TEXT_ROWS)


def release() -> None:
    """Give memory that a task no longer uses back to the machine.

    Spark keeps worker processes for later tasks; what the allocators hold on to would add to
    those tasks' memory and to that of the executor.
    """
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that releases its memory when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run
