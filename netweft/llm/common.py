"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.operators.tables import cut

__all__ = ["giving_back", "materialise", "sha_hex", "table"]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for tables that hold texts or sets: compressed tighter."""
    return cut(df, name, compression="zstd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_hex(column) -> "F.Column":
    return F.sha2(F.encode(column, "UTF-8"), 256)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The mapper, whose worker returns unused memory, Arrow's and that of freed arrays, once a partition is done: workers live on
    for the next stages."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
        if trim:
            trim(0)

    return mapped
