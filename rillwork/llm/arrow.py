"""Help for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch of whole texts, where the session doesn't say otherwise.
ROWS = 500
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which what it freed goes back to the system: idle workers stay beside the executor that they serve."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Sets batches of ``ROWS`` rows for the session unless it has a number of its own: 10,000 rows, Spark's default, are too
    many whole texts to hold several times over in executor and worker."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, str(ROWS))
