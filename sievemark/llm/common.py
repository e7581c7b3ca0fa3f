"""Shared plumbing: tables, bounded Arrow batches, and what a Python worker keeps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path, written as materialize  # noqa: F401
from ..shipping import ship

#: ASCII white space that separates words: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to a Python worker, so that long texts stay within its memory. A session that sets its own keeps them.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_HELD: dict[Hashable, Any] = {}
_WORK: list[str] = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships this package to Python workers once per application and bounds the Arrow batches they get."""
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ship(spark)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing; another key takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _begin(work: str) -> None:
    """A worker that turns to other work lets go of what it held for the last."""
    if _WORK[0] != work:
        _WORK[0] = work
        if _HELD:
            _HELD.clear()
            _give_back()


def _give_back() -> None:
    """Returns freed memory to the system; workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    work = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(work)
        yield from fn(batches)
        _give_back()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def crc32_of(col: str | Column) -> Column:
    """Unsigned crc32 of a column's decimal text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def byte_runs(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cuts ``data`` into runs of about ``size`` bytes that end at white space or the end; memory stays bounded on very long texts."""
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end
