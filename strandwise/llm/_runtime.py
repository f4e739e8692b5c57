"""Shared plumbing: durable intermediate tables and batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandwise.plans.storage import clean, cut, new_path, shared_dir

__all__ = ["clean", "lean", "new_path", "shared_dir", "table", "trim", "written"]

#: A table written to the shared folder and read again.
written = cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give free memory of this process back."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they end, a worker gives free memory back before it waits for its next task."""
    yield from batches
    trim()
