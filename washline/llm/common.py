"""What the corpus operators share: tables, written intermediate results, byte columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoints import new_folder, stored

__all__ = ["byte_values", "let_go_after", "new_folder", "table", "written"]

# A table written once below spark.checkpoint.dir: what follows neither repeats the work nor depends on
# the executors that did it.
written = stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, empty for null."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def let_go_after(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, and at the end of a task its memory goes back to the machine: workers stay for
    the next stages, and what they keep is missing there. ``forget`` drops what outlives a call."""
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for drop in forget:
                drop()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # the C library of Linux
                ctypes.CDLL(None).malloc_trim(0)

    return own
